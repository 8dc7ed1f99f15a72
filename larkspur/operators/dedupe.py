"""Deduplication and keep-best: group by key, pick or fold.

Rows carry `ingest_seq`, their place in the input, since Spark has no row order. A result row keeps the
first place of its key (`position`), as a map does that replaces a value under a known key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import join_truthy, normalized, truthy
from ..functions.urls import provider_id, provider_key


def best_by_key(rows: DataFrame, key: Column, rank: Column, seq_col: str = "ingest_seq") -> DataFrame:
    """For each key the row of the highest rank, the first of equal ones; rows with a null or empty key go.

    One aggregation with partial maxima before the shuffle, so a frequent key costs a row per task.
    """
    whole = F.struct(*rows.columns)
    picked = (
        rows.where(F.coalesce(key.cast("string") != "", F.lit(False)))
        .groupBy(key.alias("dedupe_key"))
        .agg(F.max_by(whole, F.struct(rank, -F.col(seq_col))).alias("best"), F.min(seq_col).alias("position"))
    )
    return picked.select("best.*", "position")


def first_by_key(rows: DataFrame, key: Column, seq_col: str = "ingest_seq") -> DataFrame:
    """For each key its first row."""
    return best_by_key(rows, key, F.lit(0), seq_col)


def last_by_key(rows: DataFrame, key: Column, seq_col: str = "ingest_seq") -> DataFrame:
    """For each key its last row, at the place of the first (a resumed audit replaces what it had)."""
    return best_by_key(rows, key, F.col(seq_col), seq_col)


#: Rows of a key that are folded as one array; a key with more of them is folded as a stream.
MANY = 256


def fold_by_key(rows: DataFrame, key: Column, merge: Callable[[Column, Column], Column], seq_col: str = "ingest_seq", step: Callable[[dict, dict], dict] | None = None) -> DataFrame:
    """For each key its rows merged pairwise in input order: merge(so far, next), both structs of all columns.

    For merges that depend on order. step: the same merge on two rows as dicts; with it, keys of more than MANY rows go to
    fold_sorted, so no array is longer than that. Without it a key's rows are gathered in one array whatever their number.
    """
    if step is None:
        return _folded_arrays(rows, key, merge, seq_col)
    keyed = rows.withColumn("fold_key", key)
    large = keyed.groupBy("fold_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select(F.col("fold_key").alias("large_key"))
    both = keyed.join(large, F.col("fold_key") == F.col("large_key"), "left")  # one partitioning serves the count, the join and the folds
    names = [seq_col, *(n for n in rows.columns if n != seq_col)]
    small = _folded_arrays(both.where(F.col("large_key").isNull()).select("fold_key", *names), F.col("fold_key"), merge, seq_col).select(*names, "position")
    return small.unionByName(fold_sorted(both.where(F.col("large_key").isNotNull()).select("fold_key", *names), "fold_key", step, seq_col))


def _folded_arrays(rows: DataFrame, key: Column, merge: Callable[[Column, Column], Column], seq_col: str) -> DataFrame:
    names = [n for n in rows.columns if n != "fold_key"]
    whole = F.struct(seq_col, *(n for n in names if n != seq_col))
    grouped = rows.groupBy(key.alias("dedupe_key")).agg(F.array_sort(F.collect_list(whole)).alias("all"), F.min(seq_col).alias("position"))
    folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), merge)
    return grouped.select(folded.alias("row"), "position").select("row.*", "position")


def fold_sorted(rows: DataFrame, key_col: str, step: Callable[[dict, dict], dict], seq_col: str = "ingest_seq") -> DataFrame:
    """The same fold as a stream: rows dealt by key and sorted by key and seq_col within each task (the sort spills), and one
    row of state that goes from Arrow batch to Arrow batch, so a key with millions of rows needs the memory of one. The
    columns without key_col, and position."""
    names = [n for n in rows.columns if n != key_col]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("position", rows.schema[seq_col].dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[f.name] for d in done], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = row.pop(key_col)
                if state is None or key != now:
                    if state is not None:
                        done.append(state)
                    now, state = key, row | {"position": row[seq_col]}
                else:
                    state = step(state, row) | {"position": state["position"]}
            if done:
                yield out(done)
        if state is not None:
            yield out([state])

    return rows.repartition(key_col).sortWithinPartitions(key_col, seq_col, *(n for n in names if n != seq_col and not isinstance(rows.schema[n].dataType, T.MapType))).mapInArrow(run, schema)


# Keys


def stable_key(title: Column, company: Column, location: Column, url: Column) -> Column:
    """The provider's id where the URL has one, else title, company and location in lower case."""
    text = join_truthy("|", *(F.lower(F.trim(c)) for c in (title, company, location)))
    return F.coalesce(provider_key(url, ["alljobs", "drushim", "jobmaster"]), text)


def merge_key(title: Column, company: Column, location: Column, url: Column, job_id: Column) -> Column:
    """What variants of one posting share: the provider's id, the stable key, or the job's id."""
    return F.coalesce(provider_key(url, ["alljobs"]), F.nullif(stable_key(title, company, location, url), F.lit("")), job_id)


def fingerprint_text(c: Column) -> Column:
    """Lower case without leading numbers, links and punctuation."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?<![a-z0-9_])\d{4,6}\s*-\s*", "")
    c = F.regexp_replace(c, r"https?://\S+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def fingerprint(title: Column, company: Column, location: Column, role: Column, source: Column, url: Column) -> Column:
    own = F.when(source == "AllJobs", provider_id(url, "alljobs"))
    return F.coalesce(F.concat(F.lit("alljobs:"), own), join_truthy("|", *(fingerprint_text(c) for c in (title, company, location, role))))


def store_key(title: Column, company: Column, location: Column, source: Column, url: Column) -> Column:
    """Key of the stored list: provider ids first, else source and cleaned texts."""

    def clean(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "), '[״"]', "")
        return F.trim(F.regexp_replace(c, r"^(\d+)\s*[-–]\s*", ""))

    text = F.concat(clean(source), F.lit(":"), clean(title), F.lit("|"), clean(company), F.lit("|"), clean(location))
    return F.coalesce(provider_key(url, ["alljobs", "jobmaster"]), text)


# Ranks


def store_rank(recommendation: Column, location_key: Column, fit_score: Column) -> Column:
    """300 for apply, 200 for review, 25 for a known location, and the score."""
    word = F.when(recommendation == "apply", 300).when(recommendation == "review", 200).otherwise(0)
    return word + F.when(truthy(location_key), 25).otherwise(0) + F.coalesce(fit_score, F.lit(0))


def dedupe_store(jobs: DataFrame) -> DataFrame:
    c = F.col
    location = F.coalesce(F.nullif(c("locationKey"), F.lit("")), c("location"))
    return best_by_key(jobs, store_key(c("title"), c("company"), location, c("source"), c("url")), store_rank(c("recommendation"), c("locationKey"), c("fitScore")))


def dedupe_fingerprints(jobs: DataFrame) -> DataFrame:
    c = F.col
    location = F.coalesce(F.nullif(c("locationKey"), F.lit("")), c("location"))
    role = F.coalesce(F.nullif(c("roleType"), F.lit("")), c("roleFamily"))
    return best_by_key(jobs, fingerprint(c("title"), c("company"), location, role, c("source"), c("url")), F.coalesce(c("fitScore"), F.lit(0)))


def dedupe_digest(jobs: DataFrame) -> DataFrame:
    """Postings of one mail digest: one with a URL beats one without, then the longer description."""
    c = F.col
    key = join_truthy("|", *(normalized(c(n)) for n in ("title", "company", "location")))
    return best_by_key(jobs, key, F.struct(truthy(c("url")), F.length(F.coalesce(c("description"), F.lit("")))))


def dedupe_mail_candidates(jobs: DataFrame) -> DataFrame:
    """One split from a digest beats a plain posting, and that a digest summary (a digest that isn't split), then the longer
    description; the first of equal ones."""
    c = F.col
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    kind = F.when(flag("gmailDigestSplit"), 2).when(flag("gmailDigest"), 0).otherwise(1)
    return best_by_key(jobs, c("reviewKey"), F.struct(kind, F.length(F.coalesce(c("description"), F.lit("")))))


def replace_by_id(dimension: DataFrame, new: DataFrame, id_cols: Sequence[str] = ("id",), name_col: str = "name") -> DataFrame:
    """A small dimension with rows of new in place of those with the same id, in Hebrew name order."""
    kept = dimension
    for col in id_cols:
        kept = kept.join(new.select(col).distinct(), col, "left_anti").select(dimension.columns)
    return kept.unionByName(new, allowMissingColumns=True).orderBy(F.collate(F.col(name_col), "he"))
