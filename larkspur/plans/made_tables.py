"""Posting tables made from the driver's tables: each column takes its values in turn from a short list, by the row's key.

The same lists give the DataFrame and the SQL, so an operator with fixed word lists can be checked row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


@dataclass(frozen=True)
class Made:
    """table's rows by their key, with columns (name, type, every how many keys the value changes, values)."""

    table: str
    key: str
    columns: Sequence[tuple[str, str, int, Sequence]]
    where: str = "true"

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where).select(F.col(self.key).cast("long").alias("k"))
        value = lambda kind, every, values: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.expr(f"cast((k div {every}) % {len(values)} as int)"))
        return spread(rows, "k").select("k", *(value(kind, every, values).alias(name) for name, kind, every, values in self.columns))

    @property
    def sql(self) -> str:
        """A select of the same rows."""
        kinds = {"string": "varchar", "double": "double", "int": "integer", "boolean": "boolean"}
        made = ", ".join(f"cast([{', '.join(map(literal, values))}][cast((cast({self.key} as bigint) // {every}) % {len(values)} + 1 as integer)] as {kinds[kind]}) as \"{name}\"" for name, kind, every, values in self.columns)
        return f"select cast({self.key} as bigint) as k, {made} from {self.table} where {self.where}"
