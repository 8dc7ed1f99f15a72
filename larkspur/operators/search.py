"""Faceted search over postings, tabs and sort orders, and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, or_else, text_of

ALL = "all"


def score_band(score: Column) -> Column:
    n = F.coalesce(score, F.lit(0))
    return F.when(n >= 85, "excellent").when(n >= 70, "good").when(n >= 55, "medium").otherwise("low")


def tab(name: str) -> Column:
    """Which postings a tab shows."""
    status = or_else(F.col("status"), F.lit("found"))
    tabs = {"waiting": status == "found", "applied": status.isin("applied", "interview"), "saved": status == "saved", "archive": status.isin("archived", "rejected", "skipped")}
    if name not in tabs:
        raise ValueError(f"Unknown tab: {name}")
    return tabs[name]


@dataclass(frozen=True)
class Facets:
    term: str = ""
    band: str = ALL
    source: str = ALL
    location: str = ALL
    status: str = ALL


def search(jobs: DataFrame, facets: Facets) -> DataFrame:
    """Postings that hold the term in one of seven fields and fit every facet."""
    term = facets.term.strip().lower()
    fits = F.lit(True)
    if term:
        fields = [F.col(n) for n in ("title", "company", "location", "source", "description") if n in jobs.columns]
        arrays = [F.col(n) for n in ("reasons", "warnings") if n in jobs.columns]
        fits = F.contains(F.lower(text_of(*fields, arrays=arrays)), F.lit(term))
    if facets.band != ALL:
        fits = fits & (score_band(F.col("fitScore")) == facets.band)
    for column, value in (("source", facets.source), ("location", facets.location)):
        if value != ALL:
            fits = fits & (F.coalesce(F.col(column), F.lit("")) == value)
    if facets.status != ALL:
        fits = fits & (or_else(F.col("status"), F.lit("found")) == facets.status)
    return jobs.where(fits)


def sort_order(mode: str, tie: str = "ingest_seq") -> list[Column]:
    """Sort keys of a mode, ending with the place in the input."""
    n = F.coalesce(F.col("fitScore"), F.lit(0))
    at = lambda: F.coalesce(F.col("publishedAt"), F.col("importedFromGmailAt"), F.timestamp_seconds(F.lit(0)))
    modes = {"score-desc": lambda: n.desc(), "score-asc": lambda: n.asc(), "newest": lambda: at().desc(), "oldest": lambda: at().asc(), "title": lambda: F.collate(F.coalesce(F.col("title"), F.lit("")), "he").asc()}
    if mode not in modes:
        raise ValueError(f"Unknown sort: {mode}")
    return [modes[mode](), F.col(tie).asc()]


def stored_order(tie: str = "ingest_seq") -> list[Column]:
    return [F.coalesce(F.col("fitScore"), F.lit(0)).desc(), F.coalesce(F.col("foundAt"), F.timestamp_seconds(F.lit(0))).desc(), F.col(tie).asc()]


def agent_filter(mode: str) -> Column:
    found, review = F.col("status") == "found", F.coalesce(F.col("recommendation") == "review", F.lit(False))
    digest = F.coalesce(F.col("gmailDigest"), F.lit(False)) | matches(F.col("title"), "תקציר משרות")
    modes = {"all": F.lit(True), "apply": found & ~review, "review": found & review, "digest": digest, "applied": F.col("status") == "applied", "saved": F.col("status") == "saved", "archived": F.col("status").isin("archived", "rejected")}
    if mode not in modes:
        raise ValueError(f"Unknown filter: {mode}")
    return F.coalesce(modes[mode], F.lit(False))


def agent_order() -> list[Column]:
    weight = F.when((F.col("status") == "found") & (F.col("recommendation") == "apply"), 0).when((F.col("status") == "found") & (F.col("recommendation") == "review"), 1).when(F.col("status") == "saved", 2).when(F.col("status") == "applied", 3).otherwise(4)
    return [weight.asc(), F.coalesce(F.col("fitScore"), F.lit(0)).desc()]


def retained(jobs: DataFrame, now: Column, archived_days: int = 30, applied_days: int = 180) -> DataFrame:
    """jobs without archived ones older than archived_days and applied ones older than applied_days; those without a time stay."""
    at = F.coalesce(*(F.col(n) for n in ("archivedAt", "updatedAt", "foundAt", "createdAt") if n in jobs.columns))
    old = lambda days: at < now - F.make_dt_interval(F.lit(days))
    gone = ((F.col("status") == "archived") & old(archived_days)) | (F.col("status").isin("applied", "interview") & old(applied_days))
    return jobs.where(~F.coalesce(gone, F.lit(False)))
