"""Reading and writing the tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import RoleProfile
from ..schemas import PROFILES


def json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or lines of objects; a missing path gives an empty table, other errors are raised."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parquet_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    try:
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def enabled(dimension: DataFrame) -> DataFrame:
    return dimension.where(~F.col("enabled").eqNullSafe(False))


def role_profiles(spark: SparkSession, path: str) -> list[RoleProfile]:
    """The enabled profiles, a few dozen rules, for compiling into expressions; unreadable files give none."""
    rows = enabled(json_table(spark, path, PROFILES)).collect()
    return [
        RoleProfile(r["id"], r["name"], r["positivePatterns"] or [], r["negativePatterns"] or [], r["roleFamily"] or "custom", r["roleType"], r["roleConfidence"] or "medium", r["mainListMinScore"] or 55.0, r["scoreBonus"] or 24.0, bool(r["overrideExisting"]))
        for r in rows if r["id"]
    ]


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ingest_seq, ascending by the order if one is given, else as they come from the files.

    Rows are sorted by ranges and numbered within their partition, above all partitions before: numbers
    ascend, with gaps, and no task sees all rows.
    """
    return (rows.orderBy(*order) if order else rows).withColumn("ingest_seq", F.monotonically_increasing_id())


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key of many values to spark.sql.shuffle.partitions tasks, as many as a shuffle has.

    For rows that much work follows on: a table in one file with one row group would be one task. The number is given, so
    small partitions aren't put together again: how long a row takes doesn't show in its bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, in the warehouse, or for a local master in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        base = f"file://{tempfile.gettempdir()}/larkspur-tables" if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read back: later steps start from files that every executor sees."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_table(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table as a whole; readers see the old or the new one."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, with a header, as the review dump has it."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def compacted_log(log: DataFrame, keep: int, *order: str) -> DataFrame:
    """The last `keep` rows of an append-only log."""
    return log.orderBy(*(F.desc(o) for o in order)).limit(keep)
