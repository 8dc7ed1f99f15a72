"""Counts over postings, audits, feedback and mails."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import matches, or_else


def count_by(rows: DataFrame, key: Column, unknown: str = "unknown", name: str = "key") -> DataFrame:
    return rows.groupBy(or_else(key, F.lit(unknown)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def counts(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def scan_summary(audit: DataFrame, unknown: str = "unknown") -> DataFrame:
    """By source: total, kept, filtered, apply, review; most kept first."""
    kept = F.coalesce(F.col("kept"), F.lit(False))
    said = lambda v: F.count_if(F.coalesce(F.col("recommendation") == v, F.lit(False)))
    rows = audit.groupBy(or_else(F.col("source"), F.lit(unknown)).alias("source")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"), said("apply").alias("apply"), said("review").alias("review"))
    return rows.orderBy(F.desc("kept"), F.desc("total"), "source")


def tail_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows by the order; a top-n per task, then of those, never a sort of all rows in one task."""
    return rows.orderBy(*(F.desc(o) for o in order)).limit(n)


def feedback_summary(feedback: DataFrame, last: int = 250, order: tuple[str, ...] = ("createdAt", "id")) -> DataFrame:
    recent = tail_rows(feedback, last, *order)
    out = counts(recent, {"recentEvents": F.lit(True), "positiveEvents": F.col("action").isin(V.POSITIVE_ACTIONS), "negativeEvents": F.col("action").isin(V.NEGATIVE_ACTIONS)})
    return out.crossJoin(feedback.agg(F.count(F.lit(1)).alias("totalEvents")))  # a row each


def rejection_histogram(feedback: DataFrame, last: int = 250, order: tuple[str, ...] = ("createdAt", "id")) -> DataFrame:
    recent = tail_rows(feedback, last, *order).where(F.col("action").isin(V.NEGATIVE_ACTIONS))
    return count_by(recent, F.col("rejectionReason"), "unspecified", "reason")


def mail_source(source: Column) -> Column:
    """What stands after the last dot of a mail source, else the source without its prefix."""
    s = or_else(source, F.lit("Gmail"))
    part = F.trim(F.element_at(F.split(s, "·"), -1))
    return F.when(F.contains(s, F.lit("·")), part).otherwise(or_else(F.trim(F.regexp_replace(s, r"(?i)^gmail\s*", "")), F.lit("Gmail")))


def positive_sources(feedback: DataFrame, last: int = 250, order: tuple[str, ...] = ("createdAt", "id")) -> DataFrame:
    recent = tail_rows(feedback, last, *order).where(F.col("action").isin(V.POSITIVE_ACTIONS))
    return count_by(recent, mail_source(F.col("source")), "unknown", "source")


def agent_summary(jobs: DataFrame) -> DataFrame:
    mails = jobs.where(matches(F.col("source"), "gmail"))
    status = or_else(F.col("status"), F.lit("found"))
    return counts(mails, {
        "gmailJobsTotal": F.lit(True), "activeGmailJobs": ~status.isin(V.STATUSES[1:]), "reviewGmailJobs": F.col("recommendation") == "review",
        "appliedGmailJobs": F.col("status").isin("applied", "interview"), "savedGmailJobs": F.col("status") == "saved", "digestJobs": F.col("gmailDigest"),
        "fakeSplitJobs": matches(F.col("title"), r"·\s*(?:AllJobs|Drushim|Indeed|LinkedIn)\s*#"),
    })


def waiting(status: Column) -> Column:
    return or_else(status, F.lit("found")).isin("found")


def dashboard(jobs: DataFrame, today: Column) -> DataFrame:
    status = F.col("status")
    applied = status.isin("applied", "interview")
    on = F.to_date(F.coalesce(F.col("updatedAt"), F.col("appliedAt")))
    return counts(jobs, {
        "total": waiting(status), "apply": waiting(status) & (F.col("recommendation") == "apply"), "applied": applied, "saved": status == "saved",
        "archived": status.isin("archived", "rejected", "skipped"), "appliedToday": applied & (on == today), "gmailJobs": matches(F.col("source"), "gmail"),
    })


def full_dashboard(jobs: DataFrame, review: DataFrame, feedback: DataFrame, today: Column) -> DataFrame:
    """dashboard with the rows of the review queue and the learning events; one row."""
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return dashboard(jobs, today).crossJoin(n(review, "review")).crossJoin(n(feedback, "learningEvents"))  # a row each


def scan_totals(incoming: DataFrame, scored: DataFrame, kept: DataFrame) -> DataFrame:
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    rows = one(incoming, "incoming").crossJoin(one(scored, "scored")).crossJoin(one(kept, "kept"))  # a row each
    return rows.withColumn("filtered", F.greatest(F.lit(0), F.col("scored") - F.col("kept")))


def percent(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0).otherwise(F.floor(100 * done / total + 0.5)).cast("int")


def facet(rows: DataFrame, column: str, hebrew: bool = False) -> DataFrame:
    values = rows.select(column).where(F.coalesce(F.col(column) != "", F.lit(False))).distinct()
    return values.orderBy(F.collate(F.col(column), "he") if hebrew else F.col(column))
