"""Upserts of postings into the stored table, and merging of variants of one posting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import found_in, matches, truthy
from ..functions.vocabulary import BAD_LOCATION_LABELS, CONFIDENTIAL_COMPANY, MANUAL_FIELDS
from .dedupe import fold_by_key, merge_key

def better_location(old: Column, new: Column) -> Column:
    """An empty one loses, then one with label words, then a long new one to a short old one; else the new."""
    bad = lambda c: matches(c, *BAD_LOCATION_LABELS)
    return (
        F.when(~truthy(new), old)
        .when(~truthy(old), new)
        .when(bad(new) & ~bad(old), old)
        .when(bad(old) & ~bad(new), new)
        .when((F.length(new) > 80) & (F.length(old) <= 40), old)
        .otherwise(new)
    )


def upsert(existing: DataFrame, incoming: DataFrame, now: Column, key_col: str = "job_key", present: Sequence[str] | None = None, manual: Sequence[str] = MANUAL_FIELDS) -> DataFrame:
    """Full outer merge on key_col: what both have is merged, new rows are inserted, others stay.

    present: the columns that the source of incoming fills; these override the stored ones even with null or
    an empty string, all others keep what is stored. id and foundAt stay, firstSeenAt falls back to foundAt
    and now, lastSeenAt is now, seenCount grows by one; manual fields keep a non-empty stored value. Both
    sides must be unique by key. Null keys never match and stay as rows of their own.
    """
    present = [c for c in (present or incoming.columns) if c != key_col]
    columns = [*existing.columns, *(c for c in incoming.columns if c not in existing.columns)]
    old, new = existing.alias("old"), incoming.alias("new")
    joined = old.withColumn("in_old", F.lit(True)).alias("old").join(new.withColumn("in_new", F.lit(True)).alias("new"), F.col(f"old.{key_col}") == F.col(f"new.{key_col}"), "full_outer")
    has_old, has_new = F.col("old.in_old").isNotNull(), F.col("new.in_new").isNotNull()
    side = lambda s, frame, c: F.col(f"{s}.`{c}`") if c in frame.columns else F.lit(None)

    def value(c: str) -> Column:
        o, n = side("old", existing, c), side("new", incoming, c)
        if c == key_col:
            return F.coalesce(o, n)
        text = dict(existing.dtypes).get(c, dict(incoming.dtypes).get(c)) == "string"
        full = truthy(o) if text else o.isNotNull()
        both = n if c in present else o
        if c in ("id", "foundAt"):
            both = F.coalesce(o, n)
        elif c in manual:
            both = F.when(full, o).otherwise(both)
        elif c == "location":
            both = better_location(o, n)
        elif c == "firstSeenAt":
            both = F.coalesce(o, side("old", existing, "foundAt"), n, now)
        elif c == "lastSeenAt":
            both = now
        elif c == "seenCount":
            both = F.coalesce(o, F.lit(0)) + 1
        fresh = {"seenCount": F.coalesce(n, F.lit(0)) + 1, "firstSeenAt": F.coalesce(n, side("new", incoming, "foundAt"), now), "lastSeenAt": now}.get(c, n)
        return F.when(has_old & has_new, both).when(has_old, o).otherwise(fresh)

    return joined.select(*(value(c).alias(c) for c in columns))


def variant_quality(row: Column, real_location: Column, blocked_location: Column) -> Column:
    named = truthy(row["company"]) & ~matches(row["company"], *CONFIDENTIAL_COMPANY)
    length = F.length(F.coalesce(row["description"], F.lit("")))
    return F.when(real_location, 100).otherwise(0) + F.when(blocked_location, 60).otherwise(0) + F.when(named, 15).otherwise(0) + F.least(F.lit(40), F.floor(length / 120))


def variant_step(real_location: Callable[[dict], bool], blocked_location: Callable[[dict], bool]) -> Callable[[dict, dict], dict]:
    """The merge of merge_variants on two rows as dicts, for keys with very many variants."""
    hidden = lambda name: found_in(name, *CONFIDENTIAL_COMPANY)

    def quality(x: dict) -> int:
        named = bool(x["company"]) and not hidden(x["company"])
        return 100 * real_location(x) + 60 * blocked_location(x) + 15 * named + min(40, len(x["description"] or "") // 120)

    def step(a: dict, b: dict) -> dict:
        wins = quality(b) > quality(a)
        pick, lose = (b, a) if wins else (a, b)
        out = {n: lose.get(n) if v is None else v for n, v in pick.items()}
        place = lose if not real_location(pick) and real_location(lose) else pick
        out |= {n: place[n] for n in ("location", "locationKey")}
        out["company"] = pick["company"]
        if (not pick["company"] or hidden(pick["company"])) and lose["company"] and not hidden(lose["company"]):
            out["company"] = lose["company"]
        out["description"] = lose["description"] if len(lose["description"] or "") > len(pick["description"] or "") else pick["description"]
        for n in ("id", "foundAt", "ingest_seq"):
            if n in a:
                out[n] = b[n] if a[n] is None else a[n]
        return out

    return step


def merge_variants(jobs: DataFrame, real_location, blocked_location, step: Callable[[dict, dict], dict] | None = None) -> DataFrame:
    """Variants of one posting as one row, merged pairwise in input order.

    The variant of higher quality wins, the earlier of equal ones; its location counts if it is a real one,
    else the other's if that is; a confidential company gives way to a named one; the longest description
    stays. real_location and blocked_location: functions from a row (struct) to a boolean column. A variant
    that equals an earlier one changes nothing, so repeats are aggregated away before variants are gathered.
    step: the same merge on rows as dicts (see variant_step); with it, a posting's variants are gathered only up to
    dedupe.MANY, and more of them are folded as a sorted stream.
    """
    same = [n for n in jobs.columns if n != "ingest_seq"]
    jobs = jobs.groupBy(*same).agg(F.min("ingest_seq").alias("ingest_seq"))
    c = F.col

    def merged(p: Column) -> Column:
        a, b, wins = p["a"], p["b"], p["wins"]
        pick = lambda n: F.when(wins, b[n]).otherwise(a[n])
        lose = lambda n: F.when(wins, a[n]).otherwise(b[n])
        move = F.when(wins, ~p["real_b"] & p["real_a"]).otherwise(~p["real_a"] & p["real_b"])
        fields = []
        for n in order:
            if n in ("location", "locationKey"):
                v = F.when(move, lose(n)).otherwise(pick(n))
            elif n == "company":
                hidden = ~truthy(pick(n)) | matches(pick(n), *CONFIDENTIAL_COMPANY)
                v = F.when(hidden & truthy(lose(n)) & ~matches(lose(n), *CONFIDENTIAL_COMPANY), lose(n)).otherwise(pick(n))
            elif n == "description":
                v = F.when(F.length(F.coalesce(lose(n), F.lit(""))) > F.length(F.coalesce(pick(n), F.lit(""))), lose(n)).otherwise(pick(n))
            elif n in ("id", "foundAt", "ingest_seq"):
                v = F.coalesce(a[n], b[n])
            else:
                v = F.coalesce(pick(n), lose(n))
            fields.append(v.alias(n))
        return F.struct(*fields)

    def merge(a: Column, b: Column) -> Column:
        quality = lambda x: variant_quality(x, real_location(x), blocked_location(x))
        # an array of one binds what is compared to a name, so it is worked out once and not for each field
        pair = F.struct(a.alias("a"), b.alias("b"), (quality(b) > quality(a)).alias("wins"), real_location(a).alias("real_a"), real_location(b).alias("real_b"))
        return F.get(F.transform(F.array(pair), merged), F.lit(0))

    order = ["ingest_seq", *(n for n in jobs.columns if n != "ingest_seq")]
    return fold_by_key(jobs, merge_key(c("title"), c("company"), c("location"), c("url"), c("id")), merge, step=step)


def merge_mails(stored: DataFrame, incoming: DataFrame, most: int = 500) -> DataFrame:
    """Mails by message id, field by field: what an incoming mail has counts, what it lacks is kept as stored.
    The newest `most` by date, where that is missing by importedAt."""
    columns = [*stored.columns, *(n for n in incoming.columns if n not in stored.columns)]
    old, new = stored.alias("old"), incoming.alias("new")
    side = lambda s, frame, n: F.col(f"{s}.`{n}`") if n in frame.columns else F.lit(None)
    both = old.join(new, F.col("old.id") == F.col("new.id"), "full_outer")
    merged = both.select(*(F.coalesce(side("new", incoming, n), side("old", stored, n)).alias(n) for n in columns))
    at = F.coalesce(F.col("date"), F.col("importedAt")) if "importedAt" in columns else F.col("date")
    return merged.orderBy(at.desc_nulls_last(), "id").limit(most)
