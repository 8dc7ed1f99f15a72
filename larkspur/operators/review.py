"""The review queue and the changes that people make to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import base64url, join_truthy, or_else, truthy
from ..functions.urls import provider_key
from .dedupe import best_by_key


def review_key(title: Column, company: Column, place: Column, url: Column) -> Column:
    return F.coalesce(provider_key(url, ["alljobs", "jobmaster"]), F.lower(join_truthy("|", title, company, place)))


def _key(rows: DataFrame) -> Column:
    place = or_else(F.col("locationKey"), F.col("location"))
    return review_key(F.col("title"), F.col("company"), place, F.col("url") if "url" in rows.columns else F.lit(None).cast("string"))


def review_queue(audit: DataFrame, saved: DataFrame, feedback: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """Audited postings that nobody has saved or handled, of interest and in an allowed place, best score first."""
    rows = audit.withColumn("reviewKey", _key(audit)).where(truthy(F.col("reviewKey")) & ~F.coalesce(F.col("kept"), F.lit(False)))
    rows = rows.join(saved.select(_key(saved).alias("reviewKey")).distinct(), "reviewKey", "left_anti")
    own = or_else(F.col("reviewKey"), _key(feedback)) if "reviewKey" in feedback.columns else _key(feedback)
    handled = feedback.where(F.col("action").isin(list(V.ACTION_WEIGHTS))).select(own.alias("reviewKey")).where(truthy(F.col("reviewKey"))).distinct()
    rows = rows.join(handled, "reviewKey", "left_anti")
    n = F.coalesce(F.col("fitScore"), F.lit(0))
    rows = rows.where(F.col("locationKey").isin(V.MAIN_GOOD_PLACES) & ((F.col("decision") == "filtered_other") | F.col("recommendation").isin("apply", "review") | (n >= 50)))
    best = best_by_key(rows, F.col("reviewKey"), n, seq_col)
    best = best.withColumns({"id": base64url(F.col("reviewKey")), "status": F.lit("found"), "fromManualReview": F.lit(True)})
    return best.orderBy(F.desc(F.coalesce(F.col("fitScore"), F.lit(0))), "position")


def changed_status(jobs: DataFrame, job_id: str, status: str | None, at: Column, notes: str | None = None) -> DataFrame:
    """jobs with status and notes of one posting set; an unknown status is an error, notes are cut at 2000 characters."""
    if status is not None and status not in V.STATUSES:
        raise ValueError(f"Unknown status: {status}")
    it = F.col("id").eqNullSafe(job_id)
    changes = {"updatedAt": F.when(it, at).otherwise(F.col("updatedAt"))}
    if status is not None:
        changes["status"] = F.when(it, status).otherwise(F.col("status"))
        stamp = {"applied": "appliedAt", "saved": "savedAt", "archived": "archivedAt"}.get(status)
        if stamp in jobs.columns:
            changes[stamp] = F.when(it, at).otherwise(F.col(stamp))
    if notes is not None:
        changes["notes"] = F.when(it, notes[:2000]).otherwise(F.col("notes"))
    return jobs.withColumns(changes)


def promoted(queue: DataFrame, review_id: str, at: Column) -> DataFrame:
    """The queue's posting of that id as a row for the main list."""
    return queue.where(F.col("id") == review_id).withColumns({"promotedFromReview": F.lit(True), "updatedAt": at})
