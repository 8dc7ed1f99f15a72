"""Joins between postings, audits, feedback and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else, truthy
from ..functions.urls import host_within
from .dedupe import stable_key
from .score import audit_decision


def scan_steps(queries: DataFrame, providers: Sequence[str]) -> DataFrame:
    """(step_id, step, query_index, query, provider): each query with each provider, query by query.

    queries: (query_index, query). Providers are a parameter, so they are exploded and not cross joined.
    """
    names = F.array_distinct(F.array(*(F.lit(p) for p in providers)))
    steps = queries.select("query_index", "query", F.posexplode(names).alias("p", "provider"))
    n = len(dict.fromkeys(providers))
    return steps.select(F.concat_ws(":", "query_index", "provider").alias("step_id"), (F.col("query_index") * n + F.col("p")).cast("long").alias("step"), "query_index", "query", "provider")


def new_rows(incoming: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key the run-start snapshot doesn't have."""
    return incoming.join(snapshot.select(key).distinct(), key, "left_anti")


def updated_rows(incoming: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key the run-start snapshot has."""
    return incoming.join(snapshot.select(key).distinct(), key, "left_semi")


def marked(rows: DataFrame, marks: Sequence[tuple[Column, DataFrame, str]], name: str) -> DataFrame:
    """rows with a boolean `name`: whether one of the marks holds. A mark: (key of the row, table, its key column).

    Each mark is an equi-join with distinct keys; one join on an OR of keys would compare all pairs.
    """
    out, flags = rows, []
    for i, (key, table, column) in enumerate(marks):
        flag = f"mark_{i}_"
        keys = table.select(F.col(column).alias(f"key_{i}_")).where(F.col(f"key_{i}_").isNotNull()).distinct().withColumn(flag, F.lit(True))
        out = out.join(keys, key == F.col(f"key_{i}_"), "left").drop(f"key_{i}_")
        flags.append(flag)
    hit = F.coalesce(*(F.col(f) for f in flags), F.lit(False))
    return out.withColumn(name, hit).drop(*flags)


def scan_audit(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """The audit's rows: every scored posting with kept (by stable key or id) and the reason why not."""
    key = stable_key(F.col("title"), F.col("company"), F.col("location"), F.col("url"))
    of_kept = kept.select(key.alias("key_"), "id")
    rows = marked(scored, [(key, of_kept, "key_"), (F.col("id"), of_kept, "id")], "kept")
    plain = ("title", "company", "location", "locationKey", "source", "sourceQuery", "url", "roleFamily", "roleType", "roleProfileId", "roleProfileName", "seniority", "isRelevantRole", "fitScore", "recommendation", "status")
    lists = [F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) for n in ("reasons", "warnings")]
    return rows.select(audit_decision(F.col("kept")).alias("decision"), "kept", *(c for c in plain if c in rows.columns), *lists)


def audit_key() -> Column:
    """What a resumed audit knows a posting by: its stable key, URL or id."""
    return or_else(stable_key(F.col("title"), F.col("company"), F.col("location"), F.col("url")), F.col("url"), F.coalesce(F.col("id"), F.lit("")))


def resumed_audit(before: DataFrame, new: DataFrame, before_incoming: Column, new_incoming: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of an audit that goes on: before's and new's rows by audit_key, the last counts and stands at the first's place.

    Totals (incoming, scored, kept, filtered) are one row: what came in adds up (before_incoming, new_incoming: numbers of
    rows), the others are counted over the merged rows. Both sides have ingest_seq; rows without any key go. An empty
    or missing earlier audit leaves the new one.
    """
    place = lambda rows, part: rows.withColumn("audit_seq", F.struct(F.lit(part).alias("part"), F.col("ingest_seq").alias("n")))
    both = place(before, 0).unionByName(place(new, 1), allowMissingColumns=True)
    names = [n for n in both.columns if n != "audit_seq"]
    last = both.where(truthy(audit_key())).groupBy(audit_key().alias("audit_key")).agg(F.max_by(F.struct(*names), "audit_seq").alias("last"), F.min("audit_seq").alias("position"))
    rows = last.select("last.*", "position")
    kept = F.count_if(F.coalesce(F.col("kept"), F.lit(False)))
    totals = rows.agg((before_incoming + new_incoming).cast("long").alias("incoming"), F.count(F.lit(1)).alias("scored"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("filtered"))
    return rows, totals


def by_host(results: DataFrame, sources: DataFrame, host: Column) -> DataFrame:
    """Search results with the enabled source whose domain their host is in. sources: a small dimension (id, domain, enabled)."""
    active = sources.where(~F.col("enabled").eqNullSafe(False))
    return results.join(F.broadcast(active), host_within(host, F.col("domain")))


def trusted_mails(mails: DataFrame, domains: Sequence[str], text: Column) -> DataFrame:
    """Mails whose text names a trusted domain; the list is a parameter and becomes one expression."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.contains(F.lower(text), F.lit(d.lower()))
    return mails.where(hit)


def zip_by_position(rows: DataFrame, left: str, right: str) -> DataFrame:
    """The k-th element of one array with the k-th of the other, nulls where one is shorter."""
    return rows.withColumn("pair_", F.explode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")))).select(*rows.columns, F.col("pair_.l").alias(f"{left}_item"), F.col("pair_.r").alias(f"{right}_item"))
