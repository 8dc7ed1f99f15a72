"""The two long flows as DataFrame plans: a scan of landed provider rows, and an import of mails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.rules import RoleProfile
from ..functions.text import found_in, matches, or_else, truthy
from ..operators.counters import ScanCounts
from ..operators.dedupe import dedupe_fingerprints, dedupe_mail_candidates, dedupe_store, last_by_key, merge_key
from ..operators.enrich import finalize
from ..operators.joins import new_rows, scan_audit, updated_rows
from ..operators.learning import learning_columns
from ..operators.mail import candidates, route_to_review, unprocessed, without_replaced
from ..operators.merge import merge_variants, upsert, variant_step
from ..operators.pages import search_results
from ..operators.review import _key
from ..operators.score import after_scoring, before_scoring, main_list, score
from ..sources.providers import collected, provider_of
from ..sources.tables import numbered, spread, written

c = F.col


@dataclass(frozen=True)
class Wishes:
    """What the user looks for."""

    profiles: Sequence[RoleProfile] = field(default_factory=tuple)
    target_roles: Sequence[str] = field(default_factory=tuple)
    skills: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    #: First name, as mail digests greet; any one word where it isn't given.
    first_name: str | None = None


@dataclass(frozen=True)
class Scan:
    """Results of a scan, each a plan over the scored postings, which are written."""

    scored: DataFrame
    kept: DataFrame
    audit: DataFrame
    new: DataFrame
    updated: DataFrame
    stored: DataFrame


def real_location(job: Column) -> Column:
    return truthy(job["location"]) & (job["location"] != "Israel") & truthy(job["locationKey"]) & ~job["locationKey"].isin("unknown", "null")


def blocked_location(job: Column) -> Column:
    words = F.replace(F.coalesce(job["locationKey"], F.lit("")), F.lit("_"), F.lit(" "))
    place = F.concat_ws(" ", job["location"], words)
    return matches(F.concat_ws(" ", job["title"], job["company"], place, job["description"]), *V.FINAL_BAD_PLACE_TEXT) | matches(place, *V.CENTER_TEXT)


def _real(job: dict) -> bool:
    """real_location of a row as a dict."""
    return bool(job["location"]) and job["location"] != "Israel" and bool(job["locationKey"]) and job["locationKey"] not in ("unknown", "null")


def _blocked(job: dict) -> bool:
    """blocked_location of a row as a dict."""
    place = " ".join(x for x in (job["location"], (job["locationKey"] or "").replace("_", " ")) if x is not None)
    return found_in(" ".join(x for x in (job["title"], job["company"], place, job["description"]) if x is not None), *V.FINAL_BAD_PLACE_TEXT) or found_in(place, *V.CENTER_TEXT)


def scored_jobs(jobs: DataFrame, feedback: DataFrame, wishes: Wishes) -> DataFrame:
    learned = learning_columns(before_scoring(jobs), feedback)
    return after_scoring(score(learned, wishes.target_roles, wishes.skills, wishes.exclude))


def scan(landed: Mapping[str, DataFrame], stored: DataFrame, feedback: DataFrame, wishes: Wishes, now: Column, pages: DataFrame | None = None, details: DataFrame | None = None, counts: ScanCounts | None = None) -> Scan:
    """Landed rows to postings: enrich, merge variants, score once, main list, audit, upsert into stored.

    stored: the table at the start of the run, with job_key and unique by it. pages, details: landed search pages of the
    "alljobs" provider and their postings' detail pages (see operators.pages.search_results), beside or instead of its rows.
    counts: takes the raw, normalized and scored rows of each provider in the passes that write them.
    """
    if pages is not None:
        found = search_results(pages, details)
        landed = {**landed, "alljobs": landed["alljobs"].unionByName(found, allowMissingColumns=True) if "alljobs" in landed else found}
    postings = finalize(spread(numbered(collected(landed, now, counts)), "ingest_seq"), wishes.profiles).where(c("status") != "skipped")
    merged = written(merge_variants(written(postings), real_location, blocked_location, variant_step(_real, _blocked)).drop("position"))
    scored = scored_jobs(spread(merged, "ingest_seq"), feedback, wishes).withColumn("job_key", merge_key(c("title"), c("company"), c("location"), c("url"), c("id")))
    if counts:
        scored = counts.watch(scored, "scored", provider_of(c("source")))
    scored = written(scored)  # five results below start from it
    kept = dedupe_fingerprints(main_list(scored)).drop("position")
    audit = scan_audit(scored, kept)
    updates = scored.where(c("job_key").isNotNull())
    known = updated_rows(updates, stored, "job_key").unionByName(new_rows(kept, stored, "job_key"), allowMissingColumns=True)
    known = last_by_key(known, c("job_key"))
    known = known.select(*(n for n in known.columns if n not in ("decisionGates", "ingest_seq", "position")))
    return Scan(scored, kept, audit, new_rows(kept, stored, "job_key"), updated_rows(updates, stored, "job_key"), upsert(stored, known, now))


def import_mails(mails: DataFrame, processed: DataFrame, jobs: DataFrame, feedback: DataFrame, wishes: Wishes, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(jobs with the mails' postings, the new candidates)."""
    found = candidates(unprocessed(mails, processed, force), wishes.first_name).withColumn("via", F.lit("Gmail"))
    enriched = written(finalize(found.withColumn("status", F.lit("found")), wishes.profiles))
    scored = score(learning_columns(enriched, feedback), wishes.target_roles, wishes.skills, wishes.exclude)
    routed = route_to_review(scored)
    routed = written(numbered(routed.withColumn("reviewKey", or_else(_key(routed), c("id")))))
    fresh = dedupe_mail_candidates(routed).drop("position")
    rest = without_replaced(jobs, fresh)
    both = numbered(rest.withColumn("from_", F.lit(0)).unionByName(fresh.withColumn("from_", F.lit(1)).drop("decisionGates", "ingest_seq"), allowMissingColumns=True), "from_", "id")
    return dedupe_store(both).drop("position", "from_", "ingest_seq"), fresh
