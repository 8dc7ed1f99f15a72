"""What the operators need from the session: worker code, the shared folder, batch slicing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


#: Rows of an Arrow batch where the session has Spark's default of 10,000, too many for whole texts.
ARROW_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would, and keep Arrow batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), f"larkspur_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "larkspur")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of our own, which on a cluster lies in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        base = f"file://{tempfile.gettempdir()}/larkspur-checkpoints" if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"


def saved(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends in files that every executor sees."""
    spark = df.sparkSession
    path = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores put before it until df has no such column (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: A fact that more than one in so many rows meets is broadcast; there are fewer such facts than this.
HEAVY = 1000


def met(rows: DataFrame, facts: DataFrame, keys: list[tuple[str, str]], add: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns add of the one fact that each meets, by keys (column of rows, column of facts).
    how: "inner", or "left" to keep rows without a fact, with nulls.

    weight: the fact's column that says how many of all `total` rows meet it. Rows of frequent keys meet their
    facts where they are, by a broadcast of fewer than HEAVY of them; only the others shuffle.
    """
    names = {c: new_name(rows, f"of_{c}") for _, c in keys}
    facts = facts.select(*(F.col(c).alias(n) for c, n in names.items()), *add, F.col(weight).alias(new_name(rows, "fact_rows")))
    on = [F.col(a) == F.col(names[b]) for a, b in keys]
    often = F.col(facts.columns[-1]) * HEAVY > total
    marker = names[keys[0][1]]
    tried = rows.join(F.broadcast(facts.where(often)), on, "left")
    there = tried.where(F.col(marker).isNotNull()).select(*rows.columns, *add)
    rest = tried.where(F.col(marker).isNull()).select(*rows.columns).join(facts.where(~often), on, how)
    return there.unionByName(rest.select(*rows.columns, *add))


#: Ids that may be broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Row numbers of one bitmap, and bitmaps of 4 KB that may be broadcast, 64 MB: those of 500 million rows where parts are large.
MAP_ROWS = 32_768
BROADCAST_MAPS = 16_384


def is_set(bits: Column, at: Column) -> Column:
    """Whether bit `at` of a bitmap is set; a null bitmap has none."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def without(rows: DataFrame, row_no: str, dropped: DataFrame) -> DataFrame:
    """rows but those whose row_no, from monotonically_increasing_id, is in dropped (one column).

    Dropped numbers become bitmaps, a bit for each row of a run of MAP_ROWS; up to BROADCAST_MAPS of them are broadcast and
    rows stay where they are. More of them meet the rows by a shuffle.
    """
    at, its, bits = (new_name(rows, x) for x in ("map_no", "map_of", "map_bits"))
    number = dropped.toDF("n")
    maps = saved(number.groupBy(F.expr(f"n div {MAP_ROWS}").alias(at)).agg(F.expr(f"bitmap_construct_agg(n % {MAP_ROWS})").alias(bits)))
    few = maps.count() <= BROADCAST_MAPS
    of = maps.withColumnRenamed(at, its)
    met_rows = rows.withColumn(at, F.expr(f"`{row_no}` div {MAP_ROWS}")).join(F.broadcast(of) if few else of, F.col(at) == F.col(its), "left")
    return met_rows.where(~is_set(F.col(bits), F.col(row_no) % MAP_ROWS)).select(*rows.columns)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_chars bytes of column, so that work arrays stay small whatever the texts' lengths."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most_chars:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def mapped_text(docs: DataFrame, text_col: str, added: str, work, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs with columns computed from whole texts, in Arrow batches of bounded size.

    added: DDL of the new columns; an input column of such a name is replaced. work: makes the function
    from a list of texts (None: null) to (source row of each output row or None for one to one, the new
    columns). keep: input columns to carry along, all by default; the text only with keep_text.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    new = T._parse_datatype_string(added)
    taken = {f.name.lower() for f in new}
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken and (keep_text or c.lower() != text_col.lower())]
    text = new_name(docs, "whole_text")
    narrow = docs.select(*(docs[c] for c in carried), docs[text_col].cast("string").alias(text))
    schema = T.StructType([*(narrow.schema[c] for c in carried), *new])
    arrow = to_arrow_schema(schema)

    def run(batches):
        fn = work()
        for batch in slices(batches, text):
            rows, columns = fn(batch.column(text).to_pylist())
            old = [batch.column(c) if rows is None else batch.column(c).take(pa.array(rows, pa.int64())) for c in carried]
            fresh = [pa.array(x, arrow.field(f.name).type) for f, x in zip(new, columns)]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate([*old, *fresh])], schema=arrow)

    return narrow.mapInArrow(run, schema)
