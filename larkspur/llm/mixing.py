"""Operator 5, mixing sources to target weights: Pfair scheduling, in DataFrame functions only.

Block j of a source with weight w may run from its release floor(j / w) on and has to end by its
deadline ceil((j + 1) / w). Earliest deadline first then keeps every source, at every point of the
sequence, less than one block from its share. Weights are whole parts of a period; after one period each
source has run exactly its parts, so the schedule of one period is folded once, over the parts alone, and
the place of every block of every document follows from it by arithmetic.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import new_name, saved

#: Most parts of all weights together: bounds the period's schedule.
MOST_PARTS = 4096


def period(spark: SparkSession, parts: Mapping[str, int]) -> DataFrame:
    """(share, nth, place): in which slot of one period the nth block of each share runs. sum(parts) rows."""
    total = sum(parts.values())
    names = F.array(*(F.lit(k) for k in parts))
    count = F.array(*(F.lit(n) for n in parts.values()))
    zero = F.struct(F.array(*(F.lit(0) for _ in parts)).alias("done"), F.array().cast("array<struct<i:int,nth:int>>").alias("run"))

    def slot(state: Column, t: Column) -> Column:
        # what is released by now and not over, by its deadline
        ready = F.transform(F.arrays_zip(state["done"].alias("j"), count.alias("w")), lambda x, i: F.struct(
            F.ceil((x["j"] + 1) * total / x["w"]).alias("deadline"), i.alias("i"), x["j"].alias("nth"),
            ((x["j"] < x["w"]) & (F.floor(x["j"] * total / x["w"]) <= t)).alias("open")))
        best = F.array_min(F.filter(ready, lambda x: x["open"]))
        done = F.transform(state["done"], lambda j, i: F.when(i == best["i"], j + 1).otherwise(j))
        return F.struct(done.alias("done"), F.concat(state["run"], F.array(F.struct(best["i"].cast("int").alias("i"), best["nth"].cast("int").alias("nth")))).alias("run"))

    order = F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), zero, slot, lambda s: s["run"])
    return spark.range(1).select(F.posexplode(order).alias("place", "x")).select(names[F.col("x.i")].alias("share"), F.col("x.nth").alias("nth"), "place")


def mix_sources(docs: DataFrame, weights: Mapping[str, int], others: int = 0, size: Column | None = None, block: int = 1, source_col: str = "source", id_col: str = "doc_id", rows_per_bucket: int = 200_000, seed: int = 0, slack: float = 0.0) -> DataFrame:
    """docs with share, block_no, release, deadline, position and in_mix; one row per input row.

    weights: source to target weight in whole parts; sources not named (null too) form one share "*" of
    weight others. A source's documents follow each other in the order of a seeded hash of their id and are
    cut into blocks of `block` units of size (rows if None; null or negative counts as 0), a document
    belonging to the block it begins in. position is the slot of that block in the earliest-deadline-first
    sequence. in_mix: up to there, the shares that have run out had at most `slack` of the weight (0: none
    has, so the target weights hold exactly); later positions interleave what is left, and nothing is dropped. Documents of a
    share with weight 0 have null positions and are not in the mix. Shares without any block don't take
    part. Repeated rows are placed each for itself; an empty table gives an empty one. Input columns named
    like an output column are replaced.
    """
    named = {k: n for k, n in weights.items() if n}
    if others < 0 or any(n < 0 for n in weights.values()) or not (named or others):
        raise ValueError("weights must be 0 or more, and one above 0")
    if "*" in weights:
        raise ValueError('"*" stands for the sources that are not named; give others')
    spark = docs.sparkSession
    out_names = ("share", "block_no", "release", "deadline", "position", "in_mix")
    base = docs.select(*(c for c in docs.columns if c.lower() not in out_names))
    share, units, group, rid = (new_name(base, c) for c in ("share_", "units_", "group_", "row_no_"))
    known = F.col(source_col).isin(list(weights))
    rows = base.select(
        "*",
        F.when(known, F.col(source_col)).otherwise("*").alias(share),
        (F.lit(1) if size is None else F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))).cast("long").alias(units),
        F.monotonically_increasing_id().alias(rid),
    )
    n = docs.select(F.lit(1)).count()
    groups = max(64, -(-n // rows_per_bucket))  # of each share
    # rows without an id are dealt by what else they hold
    key = F.xxhash64(F.when(F.col(id_col).isNull(), F.xxhash64(*(c for c, kind in base.dtypes if not kind.startswith("map")))).otherwise(F.xxhash64(F.col(id_col))), F.lit(seed))
    rows = rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(groups)))
    of_share, of_group, before = (new_name(rows, c) for c in ("of_share", "of_group", "before"))
    sums = rows.groupBy(F.col(share).alias(of_share), F.col(group).alias(of_group)).agg(F.sum(units).alias("held"))
    ahead = Window.partitionBy(of_share).orderBy(of_group).rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select(of_share, of_group, "held", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias(before)))

    # one row per share: weights of the shares that hold something, in lowest terms
    held = {r["s"]: r["held"] for r in sums.groupBy(F.col(of_share).alias("s")).agg(F.sum("held").alias("held")).collect()}  # at most len(weights) + 1 rows
    parts = {k: n for k, n in {**named, "*": others}.items() if n and held.get(k, 0) >= block}
    common = gcd(*parts.values()) if parts else 1
    parts = {k: n // common for k, n in parts.items()}
    total = sum(parts.values())
    if total > MOST_PARTS:
        raise ValueError(f"the weights add up to {total} parts; {MOST_PARTS} are the most")

    inside = Window.partitionBy(share, group).orderBy(key, F.col(id_col), F.col(rid)).rowsBetween(Window.unboundedPreceding, -1)
    units_inside = new_name(rows, "units_inside")
    rows = rows.withColumn(units_inside, F.coalesce(F.sum(units).over(inside), F.lit(0)))
    rows = rows.join(sums.select(of_share, of_group, before), (F.col(share) == F.col(of_share)) & (F.col(group) == F.col(of_group)))
    rows = rows.withColumn("block_no", F.floor((F.col(before) + F.col(units_inside)) / block).cast("long"))
    if not parts:
        null = F.lit(None).cast("long")
        return rows.select(*base.columns, F.col(share).alias("share"), "block_no", null.alias("release"), null.alias("deadline"), null.alias("position"), F.lit(False).alias("in_mix"))

    weight = F.create_map(*(x for k, n in parts.items() for x in (F.lit(k), F.lit(n))))
    plan = saved(period(spark, parts).coalesce(1))  # at most MOST_PARTS rows
    # when each share runs out: the slot of its first block that isn't there in full
    last = spark.createDataFrame([(k, held[k] // block) for k in parts], "share string, blocks long")
    last = last.withColumn("w", weight[F.col("share")])
    last = last.join(plan, (last["share"] == plan["share"]) & (F.col("blocks") % F.col("w") == F.col("nth")))
    last = last.select("w", (F.floor(F.col("blocks") / F.col("w")) * total + F.col("place")).alias("slot"))
    gone = F.sum("w").over(Window.orderBy("slot"))  # a row per share
    end = last.withColumn("gone", gone).where(F.col("gone") > slack * total).agg(F.min("slot")).first()[0]

    w, nth, plan_share, plan_nth, place = (new_name(rows, c) for c in ("share_weight", "nth", "plan_share", "plan_nth", "plan_place"))
    rows = rows.withColumn(w, weight[F.col(share)]).withColumn(nth, F.col("block_no") % F.col(w))
    slots = plan.select("share", "nth", "place").toDF(plan_share, plan_nth, place)
    rows = rows.join(F.broadcast(slots), (F.col(share) == F.col(plan_share)) & (F.col(nth) == F.col(plan_nth)), "left")
    position = F.floor(F.col("block_no") / F.col(w)).cast("long") * total + F.col(place)
    return rows.select(
        *base.columns,
        F.col(share).alias("share"),
        "block_no",
        F.floor(F.col("block_no") * total / F.col(w)).cast("long").alias("release"),
        F.ceil((F.col("block_no") + 1) * total / F.col(w)).cast("long").alias("deadline"),
        position.alias("position"),
        (F.coalesce(position, F.lit(end)) < end).alias("in_mix"),
    )
