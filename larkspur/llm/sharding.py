"""Operator 1, sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers run through buckets: rows are numbered inside a hash bucket, after the rows of the buckets
before. A row number goes through a keyed permutation of 0..n-1, and shard and slot are computed from
its image. Everything is DataFrame functions; the same rows get the same places whatever their
partitioning and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
#: Walks longer than this raise an error. A walk leaves the range with a chance of about 1 / sqrt(n) a step,
#: and for n up to WALK squared it can't be longer than WALK.
WALK = 64


def permuted(x: Column, n: int, seed: int) -> Column:
    """The image of x in a keyed permutation of 0..n-1.

    Feistel rounds over the rectangle a x b, the smallest near-square one that holds n: x = left * b + right,
    and left and right in turn move by a hash of the other, modulo a or b. An image outside 0..n-1 is
    permuted again until it falls inside (cycle walking), which keeps the map one-to-one.
    """
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))

    def step(at: Column) -> Column:
        start = F.struct(F.floor(at / b).cast("long").alias("l"), (at % b).cast("long").alias("r"))

        def round_(s: Column, i: Column) -> Column:
            hashed = lambda half: F.xxhash64(half, i, F.lit(seed))
            left = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(hashed(s["r"]), F.lit(a)), F.lit(a))).otherwise(s["l"])
            right = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(hashed(s["l"]), F.lit(b)), F.lit(b))).otherwise(s["r"])
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        rounds = F.array(*(F.lit(i) for i in range(ROUNDS)))
        return F.aggregate(rounds, start, round_, lambda s: s["l"] * b + s["r"])

    once = step(x)
    if a * b == n:
        return once
    walk = F.array(*(F.lit(i) for i in range(min(a * b - n, WALK))))
    walked = F.aggregate(walk, once, lambda y, _: F.when(y >= n, step(y)).otherwise(y))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk was too long: use another seed")).cast("long"))


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 0, rows_per_bucket: int = 200_000, copies_per_task: int = 10_000) -> DataFrame:
    """rows with row_no (0..n-1), shard and slot: shard and slot are the image of row_no, modulo and divided by n_shards.

    Shards differ by at most one row, and the slots of each run gapless from 0. Equal rows are first
    aggregated to one with a count and spread again in portions after numbering, so no bucket grows with
    them. Null values count as equal; an empty table gives an empty one. Columns named row_no, shard or
    slot are replaced. Rows are grouped by all their columns, so maps are not allowed among them.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    columns = [c for c in rows.columns if c.lower() not in ("row_no", "shard", "slot")]
    rows = rows.select(*columns)
    n = rows.select(F.lit(1)).count()
    buckets = max(1, -(-n // rows_per_bucket))
    inner = rows.toDF(*(f"c{i}" for i in range(len(columns))))
    keys = inner.columns
    groups = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    # one row per bucket; a window over them all sees `buckets` rows
    before = groups.groupBy(F.col("bucket").alias("b")).agg(F.sum("copies").alias("held"))
    before = before.select("b", F.coalesce(F.sum("held").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket").orderBy(*(F.col(k).asc_nulls_last() for k in keys))
    inside = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = groups.withColumn("inside", inside).join(before, F.col("bucket") == F.col("b"))
    numbered = numbered.select(*keys, "copies", (F.col("before") + F.col("inside")).alias("first"))
    portion = F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(copies_per_task)))
    single = numbered.where("copies = 1").select(*keys, F.col("first").alias("row_no"))
    many = numbered.where("copies > 1").select("*", portion.alias("portion"))
    many = many.repartition(*keys, "portion")
    copy = F.explode(F.sequence(F.col("portion"), F.least(F.col("portion") + copies_per_task, F.col("copies")) - 1))
    many = many.select(*keys, "first", copy.alias("copy")).select(*keys, (F.col("first") + F.col("copy")).alias("row_no"))
    placed = single.unionByName(many).withColumn("image", permuted(F.col("row_no"), n, seed))
    return placed.select(*(F.col(k).alias(c) for k, c in zip(keys, columns)), "row_no", (F.col("image") % n_shards).cast("int").alias("shard"), F.floor(F.col("image") / n_shards).cast("long").alias("slot"))
