"""Operator 6, exact dedup: two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets, for each row, `HASHES` bits of a filter by the hash of its normalised text, and keeps the
bits that were set twice. In pass 2 a row whose bits are not all among those is alone and passes
straight through; only the others shuffle, with counts and smallest ids pre-aggregated before.
The filter grows with the rows, so it is as good at every size. It is made of slices of at most 64 MB (33.5
million rows), all bits of a row lie in one slice, and slices are broadcast one after another, each deciding
the rows that ask it where they are. What pass 1 shuffles are up to two (bit, count) pairs a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import is_set, met, new_name, saved, without

HASHES = 2
#: Bits of one filter row; what bitmap_construct_agg gathers in one group.
ROW_BITS = 32_768
#: Filter rows of a slice, which is broadcast, of 4 KB each: 64 MB.
BROADCAST_ROWS = 16_384


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _slice(key: str, slices: int) -> Column:
    """The slice of the filter that a row asks."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(HASHES)), F.lit(slices)).cast("int")


def _bit(key: str, bits: int, i: int) -> Column:
    """The row's bit i in its slice of so many bits."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits))


def repeated_bits(rows: DataFrame, key: str, bits: int, slices: int) -> DataFrame:
    """(part, filter_row, filter_bits): of each slice the bits that two rows or more set, ROW_BITS to a row of 4 KB.
    Tasks add up their own first, so copies shuffle once a task."""
    hit = rows.select(_slice(key, slices).alias("part"), F.explode(F.array(*(_bit(key, bits, i) for i in range(HASHES)))).alias("bit"))
    hit = hit.groupBy("part", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    row = hit.groupBy("part", F.expr(f"bit div {ROW_BITS}").alias("filter_row"))
    return row.agg(F.expr(f"bitmap_construct_agg(bit % {ROW_BITS})").alias("filter_bits"))


def _asked(rows: DataFrame, found: DataFrame, key: str, bits: int, flag: str) -> DataFrame:
    """rows of one slice with flag, by a broadcast of that slice's filter rows; the rows stay where they are."""
    out = rows
    for i in range(HASHES):
        at, row, has = new_name(rows, f"bit_{i}"), new_name(rows, f"filter_row_{i}"), new_name(rows, f"filter_bits_{i}")
        out = out.withColumn(at, _bit(key, bits, i)).withColumn(row, F.expr(f"`{at}` div {ROW_BITS}"))
        one = new_name(out, "of_row")
        out = out.join(F.broadcast(found.select(F.col("filter_row").alias(one), F.col("filter_bits").alias(has))), F.col(row) == F.col(one), "left").drop(one)
        test = is_set(F.col(has), F.col(at) % ROW_BITS)
        out = out.withColumn(flag, test if i == 0 else F.col(flag) & test).drop(at, row, has)
    return out


def maybe_repeated(rows: DataFrame, key: str, n: int, bits_per_row: int, flag: str) -> DataFrame:
    """rows with flag: false only if no other row has the same key. n: how many rows there are.

    Up to BROADCAST_ROWS filter rows are one slice. Where there are more, the rows are written once and each slice's
    are decided and written by a job of their own, so only one slice is in memory and no row shuffles.
    """
    most = ROW_BITS * BROADCAST_ROWS
    slices = max(1, -(-n * bits_per_row // most))
    bits = ROW_BITS
    while bits * slices < n * bits_per_row:
        bits *= 2
    bits = min(bits, most)
    if slices == 1:
        return _asked(rows, repeated_bits(rows, key, bits, 1), key, bits, flag)
    part = new_name(rows, "part")
    rows = saved(rows.withColumn(part, _slice(key, slices)))
    found = saved(repeated_bits(rows, key, bits, slices))
    done = [saved(_asked(rows.where(F.col(part) == s), found.where(F.col("part") == s), key, bits, flag).drop(part)) for s in range(slices)]
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", key_col: str | None = None, text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """docs with text_sha256, keep_id (id of the row that stays), group_size and kept; one row per input row.

    Rows are equal when their texts are, after each run of white space became one space; null counts as
    empty. The smallest id stays, a null id only if there is no other; of repeated rows with that id one
    stays. key_col: a column that already holds text_sha256; without it texts are hashed each time docs is
    read. Input columns named like an output column are replaced. An empty table gives an empty one. docs is
    read more than once and its rows are told apart by their place, so it should come from files, or be
    saved first where its order may change.
    """
    out_names = ("text_sha256", "keep_id", "group_size", "kept")
    key = docs[key_col] if key_col else text_sha256(docs[text_col])
    carried = [c for c in docs.columns if c.lower() not in out_names]
    rid, flag, of_id = new_name(docs, "row_no"), new_name(docs, "maybe"), new_name(docs, "of_id")
    base = docs.select(*(docs[c] for c in carried), key.alias("text_sha256"), docs[id_col].alias(of_id)).withColumn(rid, F.monotonically_increasing_id())
    n = docs.select(F.lit(1)).count()
    flagged = maybe_repeated(base, "text_sha256", n, bits_per_row, flag)
    alone = flagged.where(~F.col(flag)).select(*carried, "text_sha256", F.col(of_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    several = flagged.where(flag).drop(flag)
    first = F.min(F.struct(F.col(of_id).isNull().alias("none"), F.col(of_id).alias("id"), F.col(rid).alias("row")))
    groups = several.groupBy(F.col("text_sha256").alias("key")).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    stays, copies = new_name(several, "stays"), new_name(several, "copies")
    groups = saved(groups.select("key", F.col("first").alias(stays), F.col("copies").alias(copies), F.col("copies").alias("rows")))
    several = met(several, groups, [("text_sha256", "key")], [stays, copies], "rows", n)
    several = several.select(*carried, "text_sha256", F.col(f"{stays}.id").alias("keep_id"), F.col(copies).alias("group_size"), (F.col(rid) == F.col(f"{stays}.row")).alias("kept"))
    return alone.unionByName(several)


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns. Each text is hashed once, and texts
    don't shuffle where few enough rows are dropped (see cluster.without)."""
    row_no = new_name(docs, "row_no")
    rows = docs.withColumn(row_no, F.monotonically_increasing_id())
    keys = saved(rows.select(F.col(row_no).alias("n"), F.col(id_col).alias("id"), text_sha256(F.col(text_col)).alias("key")))
    dropped = exact_dedup(keys, "id", "key").where("not kept").select("n")
    return without(rows, row_no, dropped).select(*(rows[c] for c in docs.columns))
