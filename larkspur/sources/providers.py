"""Provider rows as postings, and the registry of providers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_else, truthy
from ..functions.urls import best_apply_link, company_from_link, without_redirect

if TYPE_CHECKING:
    from ..operators.counters import ScanCounts

c = F.col
#: Names under which several providers are asked at once.
ALIASES = {"both": ["drushim", "alljobs", "jobmaster"], "all": ["drushim", "alljobs", "jobmaster", "matrix", "playwright", "sites", "serpapi"]}


def providers_of(name: str) -> list[str]:
    key = (name or "").strip().lower()
    return ALIASES.get(key, [key] if key else [])


def clean_location(location: Column) -> Column:
    """Cut at label words; what is then longer than 80 characters, or empty, is the whole country."""
    cut = F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"(?s)(?:סוג\s*משרה|היקף\s*משרה|דרישות|תיאור\s*התפקיד).*$", ""))
    return F.when((cut == "") | (F.length(cut) > 80), "Israel").otherwise(cut)


def _posting(rows: DataFrame, name: str, now: Column, **fields: Column) -> DataFrame:
    """The columns every provider fills, with the defaults for missing ones."""
    base = {"title": or_else(c("title"), F.lit("Untitled job")), "company": F.lit(name), "location": F.lit("Israel"), "description": F.lit(""), "via": F.lit(name), "source": F.lit(name), "sourceQuery": c("sourceQuery"), "url": F.lit("")} | fields
    return rows.select(*(v.alias(k) for k, v in base.items()), now.alias("foundAt"), F.lit("found").alias("status"))


def from_alljobs(rows: DataFrame, now: Column) -> DataFrame:
    return _posting(rows, "AllJobs", now, company=or_else(c("company"), F.lit("AllJobs")), location=clean_location(c("location")), description=F.coalesce(c("description"), F.lit("")), url=F.coalesce(c("link"), F.lit("")))


def _card(source: str, company: str | None = None) -> Callable[[DataFrame, Column], DataFrame]:
    def read(rows: DataFrame, now: Column) -> DataFrame:
        name = F.lit(company) if company else or_else(c("company"), F.lit(source))
        return _posting(rows, source, now, company=name, location=or_else(c("location"), F.lit("Israel")), description=F.coalesce(c("description"), F.lit("")), url=F.coalesce(c("link"), F.lit("")))

    return read


def from_site(rows: DataFrame, now: Column) -> DataFrame:
    return _posting(rows, "Site", now, company=or_else(c("company"), company_from_link(c("link"))), location=or_else(c("location"), F.lit("Israel")), description=F.coalesce(c("description"), F.lit("")), via=or_else(c("via"), F.lit("Site")), source=or_else(c("sourceName"), F.lit("Site")), url=F.coalesce(c("link"), F.lit("")))


def from_organic(rows: DataFrame, now: Column) -> DataFrame:
    return _posting(rows, "Google", now, company=or_else(c("source"), company_from_link(c("link"))), description=F.coalesce(c("snippet"), F.lit("")), url=F.coalesce(c("link"), F.lit("")))


def from_browser(rows: DataFrame, now: Column) -> DataFrame:
    link = without_redirect(c("link"))
    return _posting(rows, "Playwright", now, company=company_from_link(link), url=link)


def from_jobs_search(rows: DataFrame, now: Column) -> DataFrame:
    url = best_apply_link(c("apply_options"), c("share_link"), c("related_links"), c("detected_extensions.link"))
    return _posting(rows, "SerpApi", now, company=or_else(c("company_name"), F.lit("Unknown company")), location=or_else(c("location"), F.lit("Israel")), description=F.coalesce(c("description"), F.lit("")), via=or_else(c("via"), F.lit("Google Jobs")), url=url)


READERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "alljobs": from_alljobs, "drushim": _card("Drushim"), "jobmaster": _card("JobMaster"), "matrix": _card("Matrix", "Matrix"),
    "sites": from_site, "serpapi": from_organic, "playwright": from_browser, "serpapi_jobs": from_jobs_search,
}


def collected(landed: Mapping[str, DataFrame], now: Column, counts: ScanCounts | None = None) -> DataFrame:
    """Landed rows of all providers as postings; rows without a title or a link go. counts: takes the raw and normalized rows of each."""
    watch = counts.watch if counts else lambda rows, stage, source: rows
    parts = []
    for name, rows in landed.items():
        rows = watch(rows, "raw", F.lit(name))
        whole = truthy(c("title")) & truthy(c("link")) if "link" in rows.columns else truthy(c("title"))
        parts.append(watch(READERS[name](rows.where(whole), now), "normalized", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def provider_of(source: Column) -> Column:
    """The provider's name for the source that its postings show."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(low == "google", "serpapi").when(low == "serpapi", "serpapi_jobs").when(low.isin("alljobs", "drushim", "jobmaster", "matrix", "playwright"), low).otherwise("sites")


def provider_counts(raw: DataFrame, postings: DataFrame, scored: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(source, raw, normalized, scored) of a scan, and errors where a table of failed requests (source) is given."""
    of = lambda rows, name: rows.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    out = of(raw, "raw").join(of(postings, "normalized"), "source", "full_outer").join(of(scored, "scored"), "source", "full_outer")
    out = out if errors is None else out.join(of(errors, "errors"), "source", "full_outer")
    return out.na.fill(0)
