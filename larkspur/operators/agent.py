"""The mail agent: its settings as tables (role profiles, trusted senders, search terms), its mails as rows, and
the summaries that its panel and its imports show; and the labels and link rules that go with them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import matches, or_else, squeezed, text_of, truthy
from ..functions.urls import links_in_text, unique_links
from .summary import agent_summary, counts

c = F.col


# Settings


def role_id(name: Column) -> Column:
    """Lower case, white space and slashes as _, other characters out; null where nothing is left."""
    slug = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"[\s/\\]+", "_")
    return F.nullif(F.regexp_replace(F.regexp_replace(slug, "[^a-z0-9_א-ת-]", ""), "^_+|_+$", ""), F.lit(""))


def _items(a: Column) -> Column:
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), truthy)


def role_profiles(given: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Role profiles with defaults: what is given counts, then what is stored under the id, then the default.

    given, stored: columns of schemas.PROFILES; stored is unique by id. A profile without queries asks for its name in two places,
    without patterns it looks for its name. One with a blank name is an error, one without id and name gets a null id.
    """
    old = (stored if stored is not None else given.limit(0)).select(*(c(n).alias(f"old_{n}") for n in given.columns))
    rows = given.withColumn("key_", role_id(or_else(c("id"), c("name"))))
    rows = rows.join(old, c("key_") == c("old_id"), "left")
    either = lambda n: F.coalesce(c(n), c(f"old_{n}"))
    number = lambda n, default: F.when(F.isnan(either(n)), default).otherwise(F.coalesce(either(n), F.lit(default)))
    name = F.trim(F.coalesce(either("name"), c("key_")))
    name = F.when(name == "", F.raise_error(F.lit("A role profile needs a name"))).otherwise(name)
    rows = rows.withColumns({"name_": name, "queries_": _items(either("queries")), "positive_": _items(either("positivePatterns"))})
    return rows.select(
        c("key_").alias("id"), c("name_").alias("name"), F.coalesce(either("enabled"), F.lit(True)).alias("enabled"),
        or_else(F.trim(either("roleFamily")), F.lit("custom")).alias("roleFamily"), or_else(F.trim(either("roleType")), c("key_")).alias("roleType"),
        number("mainListMinScore", V.PROFILE_MIN_SCORE).alias("mainListMinScore"), number("scoreBonus", V.PROFILE_BONUS).alias("scoreBonus"),
        F.when(F.size("queries_") > 0, c("queries_")).otherwise(F.array(*(F.concat_ws(" ", "name_", F.lit(p)) for p in V.DEFAULT_QUERY_PLACES))).alias("queries"),
        F.when(F.size("positive_") > 0, c("positive_")).otherwise(F.array("name_")).alias("positivePatterns"), _items(either("negativePatterns")).alias("negativePatterns"),
    )


def trusted_senders(given: DataFrame) -> DataFrame:
    """Senders (id, name, domains as one string between commas, enabled, notes) with defaults; one without a domain is an error."""
    name = F.trim(F.coalesce(c("name"), F.lit("")))
    raw = F.lower(F.trim(F.coalesce(c("id"), name)))
    domains = F.transform(F.split(F.coalesce(c("domains"), F.lit("")), ","), lambda d: F.regexp_replace(F.lower(F.trim(d)), "^@", ""))
    rows = given.withColumns({"key_": F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9_-]+", "_"), "^_+|_+$", ""), "domains_": F.array_distinct(F.filter(domains, truthy))})
    return rows.select(
        F.nullif(c("key_"), F.lit("")).alias("id"), or_else(name, c("key_")).alias("name"),
        F.when(F.size("domains_") == 0, F.raise_error(F.lit("A sender needs a domain"))).otherwise(c("domains_")).alias("domains"),
        F.coalesce(c("enabled"), F.lit(True)).alias("enabled"), F.trim(F.coalesce(c("notes"), F.lit(""))).alias("notes"),
    )


def useful_term(term: Column) -> Column:
    """A search term for mails: 2 to 48 characters, not too broad, no link, no number."""
    t = F.lower(squeezed(F.translate(F.coalesce(term, F.lit("")), '"“”', "")))
    return F.length(t).between(2, 48) & ~t.isin(V.TOO_BROAD_TERMS) & ~F.rlike(t, F.lit("^https?:|^[0-9]+$"))


# Mails


def mail_rows(messages: DataFrame, now: Column) -> DataFrame:
    """Mails as rows of schemas.MAILS. messages: (id, threadId, subject, sender, internalMs, dateHeader timestamp, snippet, bodyText, bodyHtml, links)."""
    text = squeezed(c("bodyText"))
    snippet = or_else(squeezed(or_else(c("snippet"), F.substring(text, 1, 280))), F.lit(""))
    rows = messages.withColumns({"text_": text, "snippet_": snippet})
    links = F.concat(F.coalesce(c("links"), F.array().cast("array<string>")), links_in_text(F.concat_ws(" ", "text_", "snippet_")))
    return rows.select(
        F.concat(F.lit("gmail-"), "id").alias("id"), c("id").alias("gmailMessageId"), "threadId", or_else(squeezed(c("subject")), F.lit(V.NO_SUBJECT)).alias("title"),
        or_else(squeezed(c("sender")), F.lit(V.NO_SENDER)).alias("sender"), F.coalesce(F.timestamp_millis("internalMs"), c("dateHeader")).alias("date"), c("snippet_").alias("snippet"),
        c("text_").alias("bodyText"), F.coalesce(c("bodyHtml"), F.lit("")).alias("bodyHtml"), unique_links(links).alias("links"), F.lit("Gmail").alias("source"), F.lit("review").alias("status"), now.alias("importedAt"),
    )


def newer_than(rows: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """Rows of the last `days` days; the bound is a constant, so it reaches the scan."""
    return rows.where(c(column) >= now - F.make_dt_interval(F.lit(days)))


# Links and places


def blocked_path(url: Column, patterns: Sequence[str]) -> Column:
    """The URL fits one of a source's patterns, in either letter case; what doesn't compile is looked for as it stands."""
    usable = []
    for p in patterns:
        try:
            re.compile(p)
            usable.append(p)
        except re.error:
            usable.append(re.escape(p))
    return matches(url, *usable)


def browser_results(results: DataFrame, most: int = 10, order: str = "position", link: str = "link") -> DataFrame:
    """The first results that lead to one of the known hosts."""
    at = F.coalesce(c(link), F.lit(""))
    return results.where(F.rlike(at, F.lit("|".join(map(re.escape, V.BROWSER_HOSTS))))).orderBy(order).limit(most)


def first_of_source(results: DataFrame, source: str = "source", order: str = "position", most: int = 6) -> DataFrame:
    """The first `most` results of each source; ranks are limited per task before the shuffle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return results.withColumn("place_", place).where(c("place_") <= most).drop("place_")


def in_allowed_place(jobs: DataFrame) -> DataFrame:
    return jobs.where(c("locationKey").isin(V.MAIN_GOOD_PLACES))


# Searches


def mail_query(senders: DataFrame, days: int = 14) -> DataFrame:
    """One row with `query`: mails of the last days from any domain of the enabled senders (domains array<string>, enabled), in the
    order of `sender_no`; from the two known providers where there is none. A setting's senders are few."""
    domains = F.filter(F.transform("domains", lambda d: F.regexp_replace(F.trim(d), "^@", "")), lambda d: d != "")
    rows = senders.where(~c("enabled").eqNullSafe(False)).select("sender_no", F.transform(domains, lambda d: F.concat(F.lit("from:"), d)).alias("terms"))
    told = rows.agg(F.array_sort(F.collect_list(F.struct("sender_no", "terms"))).alias("all"))
    either = F.array_join(F.flatten(c("all.terms")), " OR ")
    return told.select(F.concat(F.lit(f"newer_than:{days}d ("), or_else(either, F.lit(V.DEFAULT_MAIL_QUERY)), F.lit(")")).alias("query"))


def _label(name: Column) -> Column:
    """A label's name without direction marks, closing dots and letter case; compatibility forms stay as they are."""
    return F.lower(F.trim(F.regexp_replace(squeezed(F.translate(F.coalesce(name, F.lit("")), "\u200e\u200f", "")), r"[.]+$", "")))


def label_id(labels: DataFrame, wanted: str) -> DataFrame:
    """At most one row (id): of the labels (label_no, id, name) the first with the very name, else with the plain name, else whose last
    part between slashes has it. An empty wish finds none."""
    name, plain = wanted.strip(), _label(F.lit(wanted))
    rank = F.when(F.trim(F.coalesce(c("name"), F.lit(""))) == name, 0).when(_label(c("name")) == plain, 1).when(_label(F.element_at(F.split(F.coalesce(c("name"), F.lit("")), "/"), -1)) == plain, 2)
    return labels.withColumn("rank_", rank).where(F.lit(name != "") & c("rank_").isNotNull()).orderBy("rank_", "label_no").limit(1).select("id")


# Summaries


def is_digest_row() -> Column:
    return F.coalesce(c("gmailDigest"), F.lit(False)) | matches(c("title"), V.DIGEST_TITLE)


def panel_modes() -> Mapping[str, Column]:
    """What each filter of the agent's panel shows, and what its counters count."""
    found, review = c("status") == "found", c("recommendation").eqNullSafe("review")
    return {
        "apply": found & ~review, "review": found & review, "digest": is_digest_row(), "applied": c("status") == "applied",
        "saved": c("status") == "saved", "archived": c("status").isin("archived", "rejected"),
    }


def panel_counts(jobs: DataFrame) -> DataFrame:
    return counts(jobs, {"total": F.lit(True), **panel_modes()})


def panel_rows(jobs: DataFrame, mode: str = "all", term: str = "") -> DataFrame:
    """Rows of a mode (any other name shows all) that hold the term in one of six fields."""
    rows = jobs.where(panel_modes().get(mode, F.lit(True)))
    term = term.strip().lower()
    fields = ("title", "company", "location", "source", "description", "snippet")
    return rows.where(F.contains(F.lower(text_of(*(c(n) for n in fields if n in jobs.columns))), F.lit(term))) if term else rows


def agent_overview(jobs: DataFrame, mails: DataFrame, senders: DataFrame, processed: DataFrame) -> DataFrame:
    """agent_summary with the imported mails, the active senders and the processed messages; one row."""
    rows = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    active = senders.where(~c("enabled").eqNullSafe(False))
    return agent_summary(jobs).crossJoin(rows(mails, "rawImportedEmails")).crossJoin(rows(active, "activeTrustedSenders")).crossJoin(rows(processed, "processedMessages"))  # a row each


def added_count(scored: DataFrame, remaining: DataFrame, name: str = "addedToJobs") -> DataFrame:
    """How many scored candidates have a key (column review_key) that no remaining posting has; null keys count."""
    keys = remaining.select("review_key").where(truthy(c("review_key"))).distinct()
    return scored.join(keys, "review_key", "left_anti").agg(F.count(F.lit(1)).alias(name))


def import_result(imported: DataFrame, fresh: DataFrame, scored: DataFrame, current: DataFrame, remaining: DataFrame, merged: DataFrame, at: Column, scanned: int | None = None) -> DataFrame:
    """What an import did, as one row. imported, fresh: its mails and those not processed before; scored: candidates
    with `original_skip` (the score alone would skip or force them) and review_key; current, remaining, merged: postings
    before, without the replaced ones, and after."""
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    of_scored = counts(scored, {"candidateJobs": F.lit(True), "reviewCandidates": c("recommendation") == "review", "routedToReviewByScoring": c("original_skip")})
    rows = n(imported, "imported")
    for other in (n(fresh, "processedNow"), of_scored, added_count(scored, remaining), n(current, "before"), n(remaining, "after"), n(merged, "totalJobs")):
        rows = rows.crossJoin(other)  # a row each
    return rows.select(
        (c("imported") if scanned is None else F.lit(scanned).cast("long")).alias("scanned"), "imported", "processedNow", (c("imported") - c("processedNow")).alias("alreadyProcessed"), "candidateJobs", "addedToJobs",
        F.greatest(F.lit(0), c("before") - c("after")).alias("replacedDigestSummaries"), "reviewCandidates", "routedToReviewByScoring", "totalJobs", at.alias("at"),
    )


# Labels


def source_label(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    known = F.coalesce(*(F.when(F.contains(s, F.lit(part)), F.lit(name)) for name, part in V.SOURCE_LABELS))
    return F.when(F.contains(s, F.lit("gmail")), source).otherwise(F.coalesce(known, or_else(source, F.lit(V.UNKNOWN_SOURCE_LABEL))))


def _looked_up(value: Column, labels: Mapping[str, str], default: str) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in labels.items()), F.lit(default))


def status_label(status: Column) -> Column:
    return _looked_up(status, V.STATUS_LABELS, V.NO_STATUS_LABEL)


def recommendation_label(recommendation: Column) -> Column:
    return _looked_up(recommendation, V.RECOMMENDATION_LABELS, V.REVIEW_LABEL)


def role_label(family: Column, kind: Column) -> Column:
    role = F.lower(or_else(family, F.coalesce(kind, F.lit(""))))
    return F.coalesce(*(F.when(F.contains(role, F.lit(part)), F.lit(name)) for name, part in V.ROLE_LABELS), F.lit(V.NO_ROLE_LABEL))
