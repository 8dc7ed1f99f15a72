"""Queries of the posting operators themselves, with their own word lists, over made tables (see made_tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RoleProfile
from ..functions.text import base64url, keyword_hits, number_or, or_else, same_text, split_list, unbase64url, years_at_least
from ..functions.urls import absolute, company_from_link, host, normalized_url, provider_key, unique_links
from ..operators import dedupe, enrich, joins, learning, mail, merge, review, score, search, summary
from ..sources import providers
from ..sources.tables import written
from .made_tables import Made

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PLACE = ["Haifa", "Tel Aviv", "Israel", "Nesher", "Lod", "Somewhere"]
_KEY = ["haifa", "tel_aviv", None, "nesher", "lod", ""]
#: Postings as they come to the score: role, place and signals are known.
ROLES = Made("part", "p_partkey", [
    ("title", "string", 1, ["Alpha post", "Beta manager", "Gamma post", "Delta helper"]), ("company", "string", 5, ["Acme", "", None]), ("description", "string", 2, ["", "needs 3 years", "python and sql", "over 5 years here", "travel with gloves", None, "engineer"]),
    ("location", "string", 3, _PLACE), ("locationKey", "string", 3, _KEY), ("via", "string", 1, ["Acme"]), ("source", "string", 11, ["Drushim", "AllJobs", "Matrix"]),
    ("roleFamily", "string", 7, ["information_systems", "information", "analysis", "operations", "sales", "irrelevant", "unknown"]), ("roleType", "string", 13, ["implementer", "sap_implementer", "document_control"]),
    ("isRelevantRole", "boolean", 17, [True, True, False]), ("roleConfidence", "string", 19, ["high", "medium"]), ("seniority", "string", 23, ["junior", "unknown", "unknown"]), ("hasNoExperienceSignal", "boolean", 5, [False, False, True]),
    ("roleProfileId", "string", 29, [None, None, "p1", ""]), ("roleProfileName", "string", 29, [None, None, "P", None]), ("roleProfileScoreBonus", "double", 31, [0.0, 24.0, None]), ("url", "string", 37, ["https://x.example/?JobID=1", "https://x.example/?JobID=2", "https://x.example/?JobID=3", ""]),
    ("status", "string", 41, ["found", "applied", "saved"]), ("fitScore", "int", 1, list(range(0, 101, 7))), ("mainListMinScore", "double", 43, [None, 0.0, 60.0]), ("recommendation", "string", 3, ["apply", "review", "skip", None]),
])
_BAD = "('tel_aviv', 'lod')"
_POINTS = f"""with r as ({ROLES.sql}), s as (select *, coalesce("roleFamily" = 'irrelevant' or ("isRelevantRole" = false and "roleConfidence" = 'high'), false) as out_,
  contains(title, 'manager') or contains(coalesce(description, ''), '5 years') as senior, lower(title || ' ' || coalesce(company, '') || ' ' || location || ' ' || coalesce(description, '')) as t from r),
p as (select *, 20 + case when coalesce("roleProfileId", '') <> '' then coalesce(nullif("roleProfileScoreBonus", 0), 26) else 0 end
  + case "roleFamily" when 'information_systems' then 26 when 'information' then 16 when 'analysis' then 28 when 'operations' then 22 else case when "isRelevantRole" then 18 else -25 end end
  + case when "roleType" = 'sap_implementer' then 4 else 0 end + case when seniority = 'junior' or "hasNoExperienceSignal" then 18 else 0 end - case when senior then 35 else 0 end
  - case when contains(coalesce(description, ''), '5 years') then 35 when contains(coalesce(description, ''), '3 years') then 18 else 0 end
  + case when "locationKey" in ('haifa', 'nesher') then 16 when "locationKey" = 'tel_aviv' then -22 when coalesce("locationKey", '') = '' then -10 else 0 end
  + least(12, 4 * (contains(t, 'engineer')::int + contains(t, 'helper')::int + contains(t, 'post')::int + contains(t, 'manager')::int)) + least(12, 3 * (contains(t, 'python')::int + contains(t, 'sql')::int))
  - least(35, 8 * (contains(t, 'travel')::int + contains(t, 'gloves')::int)) - case when url = '' then 10 else 0 end as points from s),
f as (select *, case when out_ then 0 else cast(floor(greatest(0, least(100, points)) + 0.5) as integer) end as n from p)
"""
#: The gates over a score n: domain by family, then the first that closes.
_GATED = """, d as (select *, case when "roleFamily" = 'information_systems' or "roleType" = 'sap_implementer' then 'information_systems' when "roleFamily" in ('information', 'analysis', 'operations') then 'quiet_admin_data'
  when "roleFamily" = 'irrelevant' or "isRelevantRole" = false then 'irrelevant' else 'unknown' end as dom, coalesce("locationKey", '') in ('tel_aviv', 'lod') or location in ('Tel Aviv', 'Lod') as badplace,
  coalesce("locationKey", '') = '' or location = 'Israel' as noplace, contains(title, 'manager') or contains(coalesce(description, ''), '5 years') or contains(coalesce(description, ''), '3 years') as old from f),
g as (select *, case when "roleFamily" = 'sales' then 'hard' when badplace then 'place' when dom = 'irrelevant' then 'irrelevant' when dom = 'unknown' then 'role' when noplace then 'unknown_place' when old then 'senior' else 'open' end as gate from d),
o as (select k, dom as "roleDomain", case gate when 'hard' then greatest(0, least(20, n)) when 'place' then greatest(0, least(40, n)) when 'irrelevant' then greatest(0, least(35, n)) else n end as "fitScore",
  case when gate in ('hard', 'place', 'irrelevant') then 'skip' when gate = 'role' then case when n >= 45 then 'review' else 'skip' end when gate in ('unknown_place', 'senior') then 'review'
    when "locationKey" in ('haifa', 'nesher') and n >= 75 then 'apply' when n < 45 then 'skip' else 'review' end as recommendation,
  case when gate in ('hard', 'place', 'irrelevant') and st <> 'applied' then 'skipped' else st end as status from g)
"""


@_query(_POINTS + ", f2 as (select *, case when out_ then 'skipped' else status end as st from f)" + _GATED.replace("from f)", "from f2)") + 'select k, "fitScore", recommendation, status, "roleDomain" from o')
def score_additive_clamped(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).drop("recommendation", "fitScore").withColumn("roleSignals", F.array().cast("array<string>"))
    scored = score.score(rows, ["engineer", "helper", "post", "manager"], ["python", "sql"], ["travel", "gloves"])
    return scored.select("k", "fitScore", "recommendation", "status", "roleDomain")


@_query(f'with r as ({ROLES.sql}), f as (select *, "fitScore" as n, status as st from r)' + _GATED + 'select k, "fitScore", recommendation, status, "roleDomain" from o')
def decision_gates(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = score.with_texts(ROLES.rows(spark, sf_dir).withColumns({"roleSignals": none, "reasons": none, "warnings": none}))
    return score.decision_gates(score.decision_dimensions(rows)).select("k", "fitScore", "recommendation", "status", "roleDomain")


@_query(f"""with r as ({ROLES.sql}), f as (select *, coalesce("roleProfileId", '') <> '' as p, contains(title, 'manager') or contains(coalesce(description, ''), '5 years') as senior, "fitScore" as n, coalesce(nullif("mainListMinScore", 0), 55) as least_ from r)
select k, "fitScore" from f where "locationKey" in ('haifa', 'nesher') and status <> 'skipped' and coalesce(recommendation, '') <> 'skip' and n > 0 and "roleFamily" <> 'irrelevant' and "isRelevantRole"
  and case when source = 'AllJobs' then url <> '' and not senior and case when p then n >= greatest(55, least_) when "roleFamily" = 'information_systems' then n >= 65 when "roleFamily" = 'information' then n >= 70 when "roleFamily" in ('analysis', 'operations') then n >= 60 else false end
  else case when p then not senior and n >= least_ when "roleFamily" = 'information_systems' then not senior and n >= 45 when "roleFamily" = 'information' then not senior and n >= 60 when "roleFamily" in ('analysis', 'operations') then not senior and n >= 55 else n >= 70 end end""")
def main_list_filter(spark, sf_dir):
    return score.main_list(ROLES.rows(spark, sf_dir)).select("k", "fitScore")


@_query(f"""with r as ({ROLES.sql}), a as (select *, "locationKey" in ('haifa', 'nesher') as good_, k % 2 = 0 as kept from r)
select case when kept then 'kept_duplicate_or_saved' when status = 'skipped' then 'filtered_status_skipped' when recommendation = 'skip' then 'filtered_recommendation_skip' when "roleFamily" = 'irrelevant' then 'filtered_irrelevant_role'
  when "fitScore" < 40 then 'filtered_low_score' else 'filtered_other' end as decision, count(*) as n from a group by 1""")
def scan_audit_decisions(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).withColumns({"id": c("k").cast("string"), "title": F.concat("title", F.lit(" "), "k"), "url": F.lit(""), "reasons": F.lit(None).cast("array<string>"), "warnings": F.lit(None).cast("array<string>")})
    return joins.scan_audit(rows, rows.where("k % 2 = 0")).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with r as ({ROLES.sql}), b as (select *, location = 'Tel Aviv' as blocked, "locationKey" in ('haifa', 'nesher') as good_, contains(title, 'manager') or regexp_matches(coalesce(description, ''), '[35] years') as old from r)
select k, case when blocked then 'skip' when recommendation = 'apply' and (not coalesce(good_, false) or old) then 'review' else recommendation end as recommendation, case when blocked then 'skipped' else status end as status from b""")
def after_scoring_moves(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).withColumn("warnings", F.array().cast("array<string>"))
    return score.after_scoring(rows).select("k", "recommendation", "status")


@_query(f"""with r as ({ROLES.sql}), t as (select k, case when regexp_matches(title, '(?i)helper|alpha') and not contains(coalesce(description, ''), 'python') then 'one' when contains(title, 'post') or contains(coalesce(description, ''), 'sql') then 'two' end as id,
  "isRelevantRole" and "roleFamily" <> 'unknown' and "roleConfidence" = 'high' as sure, * exclude (k) from r),
m as (select *, case id when 'one' then 'qa' when 'two' then 'custom' end as fam from t)
select k, case when id = 'two' and sure then null else id end as "roleProfileId", case when id = 'one' then 'qa' when id = 'two' and not sure then 'custom' else "roleFamily" end as "roleFamily",
  case when id = 'one' then cast(71 as double) when id = 'two' and not sure then 55 end as "mainListMinScore" from m""")
def role_profile_theta(spark, sf_dir):
    profiles = [RoleProfile("one", "One", ["helper", "alpha"], ["python"], "qa", main_list_min_score=71, override_existing=True), RoleProfile("two", "Two", ["post", "sql"]), RoleProfile("off", "Off", ["delta"], enabled=False)]
    rows = ROLES.rows(spark, sf_dir).withColumn("roleSignals", F.array().cast("array<string>"))
    return enrich.profile_columns(rows, profiles).select("k", "roleProfileId", "roleFamily", "mainListMinScore")


#: Feedback: rejected and liked postings.
LOG = Made("events", "event_id", [
    ("jobId", "string", 1, ["1", "2", "3", "4", "5"]), ("action", "string", 1, ["saved", "applied", "interview", "deleted", "skipped", "rejected", "not_relevant", "seen"]), ("rejectionReason", "string", 3, [None, None, "shifts", None, "other", "tech_stack", ""]),
    ("title", "string", 1, ["zebra one", "heron two"]), ("company", "string", 7, ["Acme", "Bolt", ""]), ("location", "string", 5, ["Haifa", "Israel", "Nesher"]), ("locationKey", "string", 5, ["haifa", None, "nesher"]), ("source", "string", 11, ["Drushim", "AllJobs"]),
    ("roleType", "string", 13, ["implementer", "sap_implementer"]), ("roleProfileId", "string", 17, [None, "p1"]), ("fitScore", "int", 1, [10, 60]),
])
_WEIGHT = "case action when 'saved' then 7 when 'applied' then 14 when 'interview' then 18 when 'deleted' then -14 when 'skipped' then -12 when 'rejected' then -10 when 'not_relevant' then -16 else 0 end"


def _log(spark, sf_dir) -> DataFrame:
    return LOG.rows(spark, sf_dir).withColumns({"createdAt": c("k"), "id": c("k").cast("string")})


@_query(f"""with l as ({LOG.sql}), r as (select * from l order by k desc limit 250)
select count(*) as "recentEvents", count(*) filter (where action in ('saved', 'applied', 'interview')) as "positiveEvents", count(*) filter (where action in ('deleted', 'rejected', 'skipped', 'not_relevant')) as "negativeEvents", (select count(*) from l) as "totalEvents" from r""")
def feedback_tail_summary(spark, sf_dir):
    return summary.feedback_summary(_log(spark, sf_dir))


@_query(f"""with l as ({LOG.sql}), r as (select * from l order by k desc limit 250) select coalesce(nullif("rejectionReason", ''), 'unspecified') as reason, count(*) as n from r where action in ('deleted', 'rejected', 'skipped', 'not_relevant') group by 1""")
def rejection_histogram(spark, sf_dir):
    return summary.rejection_histogram(_log(spark, sf_dir))


#: Postings that share fields with the log, but no words.
LIKE = Made("part", "p_partkey", [
    ("company", "string", 1, ["Acme", "Cord", "", "ACME "]), ("location", "string", 2, ["Haifa", "Israel", "Nesher", None]), ("locationKey", "string", 2, ["haifa", None, "nesher", None]), ("source", "string", 3, ["Drushim", "AllJobs", "Matrix"]),
    ("roleType", "string", 5, ["implementer", "other"]), ("roleProfileId", "string", 7, [None, "p1", "p2"]),
])


@_query(f"""with l as (select *, {_WEIGHT} as w, "rejectionReason" as rr from ({LOG.sql}) order by k desc limit 400), j as (select *, cast(k % 9 as varchar) as id, lower(trim(company)) as co from ({LIKE.sql})),
e as (select j.k, w * least(1.2, case when co <> '' and co = lower(l.company) then 0.5 else 0 end + case when j."locationKey" = l."locationKey" then 0.45 else 0 end
  + case when j."roleType" = l."roleType" then 0.55 else 0 end + case when j."roleProfileId" = l."roleProfileId" then 0.65 else 0 end + case when j.source = l.source then 0.25 else 0 end)
  + case when w <> 0 and o >= 2 then sign(w) * (least(abs(w), o * 1.4) + case when j.location = l.location and j.location <> 'Israel' then 2 else 0 end + case when j.source = l.source then 1 else 0 end) else 0 end as points
  from (select j.*, l.k as lk, len(list_intersect(list_filter(list_distinct([lower(coalesce(j.company, '')), lower(coalesce(j.location, '')), coalesce(j."locationKey", ''), lower(j.source), lower(j."roleType")]), lambda x: len(trim(x)) >= 3),
    list_distinct([lower(l.company), lower(l.location), coalesce(l."locationKey", ''), lower(l.source), lower(l."roleType"), split_part(l.title, ' ', 1), split_part(l.title, ' ', 2)]))) as o from j cross join l) j join l on l.k = j.lk where l."jobId" <> j.id)
select j.k, coalesce(cast(greatest(-32, least(22, floor((select sum(points) from e where e.k = j.k) + 0.5))) as double), 0) as learning_adjustment from j""".replace("lower(coalesce(j.company, ''))", "lower(trim(coalesce(j.company, '')))"))
def learning_adjustment(spark, sf_dir):
    jobs = LIKE.rows(spark, sf_dir).withColumn("id", (c("k") % 9).cast("string"))
    return learning.learning_columns(jobs, _log(spark, sf_dir)).select("k", "learning_adjustment")


#: Postings of the tester's trade and beside it: software, automation, factory quality, developers, paid-only and shift work.
QA_POSTS = Made("part", "p_partkey", [
    ("title", "string", 1, ["QA Engineer", "QA Automation Engineer", "Manual QA tester", "Full Stack Developer", "Plain post"]), ("company", "string", 1, ["Acme"]), ("description", "string", 5, ["software testing of web apps", "", "quality control in מפעל", "needs 3 years", "work in משמרות", "premium only"]),
    ("location", "string", 2, ["Haifa", "Lod", "Israel"]), ("locationKey", "string", 2, ["haifa", "lod", None]), ("via", "string", 1, ["x"]), ("source", "string", 11, ["Drushim", "AllJobs"]), ("url", "string", 1, ["https://x.example/?JobID=1"]), ("status", "string", 1, ["found"]),
    ("roleFamily", "string", 7, ["unknown", "information_systems"]), ("roleType", "string", 1, [None]), ("isRelevantRole", "boolean", 1, [True]), ("roleConfidence", "string", 3, ["high", "medium"]), ("seniority", "string", 13, ["junior", "unknown"]), ("hasNoExperienceSignal", "boolean", 1, [False]),
])


@_query(f"""with r as ({QA_POSTS.sql}), b as (select *, title like '%QA%' as qat, lower(title || ' ' || description) as td from r),
f as (select *, case when qat then 'qa' else "roleFamily" end as fam0, case when qat then case when contains(td, 'automation') then 'qa_automation' when contains(td, 'manual') then 'qa_manual' else 'qa_general' end end as type0,
  (source = 'AllJobs' and description = 'premium only') or title = 'Full Stack Developer' as hard_exit, contains(td, 'automation') or contains(td, 'software') or contains(td, 'qa tester') as signal, contains(description, 'מפעל') as factory, contains(description, 'משמרות') as shifts, contains(description, '3 years') as three from b),
x as (select *, hard_exit or (fam0 = 'qa' and factory and not signal) or shifts as out_, case when hard_exit then 'irrelevant' else fam0 end as fam from f),
n as (select *, case when out_ then 0 else greatest(0, least(100, 20 + case fam when 'qa' then 38 when 'information_systems' then 26 else 18 end + case type0 when 'qa_manual' then 10 when 'qa_automation' then 6 else 0 end + case when seniority = 'junior' then 18 else 0 end - case when three then 18 else 0 end
  + case "locationKey" when 'haifa' then 16 when 'lod' then 0 else -10 end)) end as n, contains(td, 'qa tester') or contains(td, 'software testing') as sw, qat or contains(td, 'testing') as seen_qa from x),
d as (select *, case when factory and seen_qa and not sw then 'business_quality' when seen_qa and contains(td, 'automation') and sw then 'automation_qa' when seen_qa and sw then 'software_qa' when seen_qa then 'qa_uncertain' when fam = 'information_systems' then 'information_systems' when fam = 'irrelevant' then 'irrelevant' else 'unknown' end as dom from n),
g as (select *, case when shifts then 'hard' when "locationKey" = 'lod' then 'place' when dom = 'business_quality' then 'business' when dom = 'irrelevant' then 'irrelevant' when dom = 'qa_uncertain' then 'uncertain' when dom = 'unknown' then 'role' when "locationKey" is null then 'unknown_place' when three then 'senior' else 'open' end as gate from d),
o as (select *, least(n, case gate when 'hard' then 20 when 'place' then 40 when 'business' then 35 when 'irrelevant' then 35 else 100 end) as fit, gate in ('hard', 'place', 'business', 'irrelevant') as closed,
  case when gate in ('hard', 'place', 'business', 'irrelevant') then 'skip' when gate in ('uncertain', 'role') then case when n >= 45 then 'review' else 'skip' end when gate in ('unknown_place', 'senior') then 'review' when n >= 75 then 'apply' when n < 45 then 'skip' else 'review' end as rec from g)
select k, fam as "roleFamily", dom as "roleDomain", cast(fit as integer) as "fitScore", rec as recommendation, case when out_ or closed then 'skipped' else 'found' end as status,
  rec <> 'skip' and not out_ and fit > 0 and ("locationKey" = 'haifa' or (source = 'AllJobs' and "locationKey" is null and fam = 'qa' and fit >= 75)) is true and case when source = 'AllJobs' then case fam when 'qa' then fit >= 50 when 'information_systems' then fit >= 65 else false end else case fam when 'qa' then fit >= 25 when 'information_systems' then fit >= 45 else fit >= 70 end end as listed from o""")
def qa_postings_judged(spark, sf_dir):
    rows = QA_POSTS.rows(spark, sf_dir).withColumn("roleSignals", F.array().cast("array<string>"))
    judged = written(score.after_scoring(score.score(score.before_scoring(rows))))
    for name, kind in (("roleProfileId", "string"), ("roleProfileName", "string"), ("mainListMinScore", "double")):
        judged = judged if name in judged.columns else judged.withColumn(name, F.lit(None).cast(kind))
    return judged.select("k", "roleFamily", "roleDomain", "fitScore", "recommendation", "status", score.usable_for_main_list().alias("listed"))


#: A log and postings that set off the rules of reasons: by text, place and role, each also where it must not.
REASONED = Made("events", "event_id", [
    ("jobId", "string", 1, ["1", "2", "3", "4", "5", "6"]), ("action", "string", 1, ["rejected", "saved", "deleted", "not_relevant", "applied"]), ("rejectionReason", "string", 1, ["shifts", "location", "wrong_role", "", None, "sales", "bogus"]),
    ("title", "string", 2, ["zebra clerk", "heron keeper", "otter", ""]), ("company", "string", 3, ["Acme", ""]), ("location", "string", 3, ["Haifa", "Israel", "Nesher", ""]), ("locationKey", "string", 3, ["haifa", None, "nesher", ""]), ("source", "string", 11, ["Drushim", "AllJobs"]),
    ("roleType", "string", 5, ["implementer", "", "tester"]), ("roleProfileId", "string", 17, [None, "p1"]), ("description", "string", 7, ["calm river words", "night desk", None]),
])
JUDGED = Made("part", "p_partkey", [
    ("title", "string", 1, ["zebra clerk", "otter keeper", "heron", "zebra heron keeper", ""]), ("company", "string", 3, ["Acme", "Cord", ""]), ("location", "string", 2, ["Haifa", "Israel", "nesher", None, ""]), ("locationKey", "string", 2, ["haifa", "haifa", "nesher", None, ""]), ("source", "string", 5, ["Drushim", "Matrix"]),
    ("roleType", "string", 7, ["implementer", "other", ""]), ("roleProfileId", "string", 11, [None, "p1"]), ("description", "string", 1, ["calm river", "night work", "sales of night", None]),
])
_SAY = {"shifts": "למידה: בעבר פסלת משרות עם מאפיין דומה — משמרות / לילות / סופי שבוע.", "sales": "למידה: בעבר פסלת משרות עם מאפיין דומה — מכירות / ביזנס מדי.", "wrong_role": "למידה: בעבר פסלת תפקיד דומה."}
_WORDS = lambda t, *fs: "list_distinct(list_filter(string_split(lower(concat_ws(' ', " + ", ".join(f"{t}.\"{f}\"" for f in fs) + ")), ' '), lambda x: len(x) >= 3))"
_ALL_WORDS, _TITLE_WORDS = ("title", "company", "location", "locationKey", "description", "source", "roleType"), ("title", "roleType")


@_query(f"""with l as (select *, {_WEIGHT} as w, nullif("rejectionReason", '') as rr from ({REASONED.sql}) order by k desc limit 400), j as (select *, cast(k % 9 as varchar) as id from ({JUDGED.sql})),
w as (select l.k as lk, {_WORDS('l', *_ALL_WORDS)} as lw, {_WORDS('l', *_TITLE_WORDS)} as lt from l), v as (select j.k as jk, {_WORDS('j', *_ALL_WORDS)} as jw, {_WORDS('j', *_TITLE_WORDS)} as jt from j),
p as (select j.k, l.k as lk, l.rr, l.w, len(list_intersect(jw, lw)) as o, j.location as place,
  coalesce(l.rr = 'shifts' and contains(j.description, 'night'), false) or coalesce(l.rr = 'sales' and contains(j.description, 'sales'), false) as by_text,
  coalesce(nullif(j.company, '') = nullif(l.company, ''), false) as co, coalesce(nullif(lower(j.location), '') = nullif(lower(l.location), ''), false) as lo, coalesce(nullif(j."locationKey", '') = nullif(l."locationKey", ''), false) as lk_, coalesce(nullif(j."roleType", '') = nullif(l."roleType", ''), false) as ro,
  coalesce(j."roleProfileId" = l."roleProfileId", false) as pr, j.source = l.source as so, coalesce(lower(j.location), '') not in ('', 'israel') as real_, len(list_intersect(jt, lt)) >= 2 as tw
  from j cross join l join w on w.lk = l.k join v on v.jk = j.k where l."jobId" <> j.id),
e as (select *, case when by_text then case rr when 'shifts' then '{_SAY["shifts"]}' else '{_SAY["sales"]}' end when rr = 'location' and (lk_ or lo) and real_ then 'למידה: בעבר פסלת מיקום דומה (' || place || ').' when rr = 'wrong_role' and (tw or ro) then '{_SAY["wrong_role"]}' end as said,
  case when o >= 2 and w <> 0 then sign(w) * (least(abs(w), o * 1.4) + case when lo and real_ then 2 else 0 end + case when so then 1 else 0 end) else 0 end + w * least(1.2, case when co then 0.5 else 0 end + case when lk_ then 0.45 else 0 end + case when ro then 0.55 else 0 end + case when pr then 0.65 else 0 end + case when so then 0.25 else 0 end) as alike from p),
t as (select k, greatest(-32, least(22, floor(sum(case when said is null then alike when rr = 'wrong_role' then -16 else -18 end) + 0.5))) as total from e group by k),
s as (select k, string_agg(said, '|' order by first_lk) as told from (select k, said, min(lk) as first_lk from e where said is not null group by all) group by k)
select k, cast(total as double) as learning_adjustment, coalesce(told, '') || case when total <= -4 then case when told is null then '' else '|' end || 'למידה: משרות דומות נדחו בעבר (' || cast(cast(total as integer) as varchar) || ').' else '' end as warnings from t left join s using (k)""")
def learning_rules(spark, sf_dir):
    log = REASONED.rows(spark, sf_dir).withColumns({"createdAt": c("k"), "id": c("k").cast("string")})
    jobs = JUDGED.rows(spark, sf_dir).withColumn("id", (c("k") % 9).cast("string"))
    return learning.learning_columns(jobs, log).select("k", "learning_adjustment", F.array_join("learning_warnings", "|").alias("warnings"))


#: An audit, and what people saved and handled.
AUDIT = Made("part", "p_partkey", [
    ("title", "string", 3, ["One", "Two", "Three", "Four", "Five"]), ("company", "string", 7, ["Acme", "Bolt", None]), ("location", "string", 2, ["Haifa", "Lod", "Nesher"]), ("locationKey", "string", 2, ["haifa", "lod", "nesher"]), ("url", "string", 1, ["", "https://x.example/?JobID=7", None]),
    ("kept", "boolean", 5, [False, None, True]), ("fitScore", "int", 1, [10, 55, 49, 90, None]), ("recommendation", "string", 3, ["skip", "review"]), ("decision", "string", 11, ["filtered_other", "filtered_low_score", "filtered_low_score"]),
])


@_query(f"""with a as (select *, case when contains(coalesce(url, ''), 'JobID') then 'alljobs:7' else lower(concat_ws('|', nullif(title, ''), nullif(company, ''), "locationKey")) end as key from ({AUDIT.sql})),
b as (select * from a where not coalesce(kept, false) and key not in (select key from a where k % 97 = 1) and key not in (select key from a where k % 89 = 2) and "locationKey" in ('haifa', 'nesher') and (decision = 'filtered_other' or recommendation = 'review' or coalesce("fitScore", 0) >= 50)),
x as (select *, row_number() over (partition by key order by coalesce("fitScore", 0) desc, k) as rn, min(k) over (partition by key) as position from b)
select k, key as "reviewKey", rtrim(translate(to_base64(encode(key)), '+/', '-_'), '=') as id, "fitScore", position from x where rn = 1""")
def review_queue(spark, sf_dir):
    rows = AUDIT.rows(spark, sf_dir).withColumn("ingest_seq", c("k"))
    feedback = rows.where("k % 89 = 2").withColumn("action", F.lit("saved"))
    return review.review_queue(rows, rows.where("k % 97 = 1"), feedback).select("k", "reviewKey", "id", "fitScore", "position")


@_query(f"""select k, case when k = 5 then 'applied' else status end as status, k = 5 as stamped, case when k = 5 then 'sent' end as notes from ({ROLES.sql})""")
def status_change(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).withColumns({"id": c("k").cast("string"), "updatedAt": F.lit(None).cast("timestamp"), "appliedAt": F.lit(None).cast("timestamp"), "notes": F.lit(None).cast("string")})
    out = review.changed_status(rows, "5", "applied", F.lit("2024-01-01").cast("timestamp"), "sent")
    return out.select("k", "status", (c("appliedAt").isNotNull() & c("updatedAt").isNotNull()).alias("stamped"), "notes")


#: Variants of postings: several rows to a provider's id.
VARIANTS = Made("part", "p_partkey", [
    ("title", "string", 1, ["One", "Two"]), ("company", "string", 1, ["חברה חסויה", "Acme", "", "Bolt", None]), ("location", "string", 1, ["Haifa", "Israel", None, "Ashdod", "Nesher", "Israel", "Acre"]), ("locationKey", "string", 1, ["haifa", None, None, "ashdod", "nesher", "unknown", "acre"]),
    ("description", "string", 1, ["", "x" * 119, "x" * 130, None, "y" * 250, "z" * 40, "w" * 3, "v" * 700]), ("note", "string", 2, [None, "n1", "n2"]),
])
_REAL = "{0}.location <> 'Israel' and {0}.\"locationKey\" <> 'unknown'"
_QUALITY = "(case when coalesce({0}.location <> 'Israel' and {0}.\"locationKey\" <> 'unknown', false) then 100 else 0 end + case when coalesce({0}.\"locationKey\", '') = 'ashdod' then 60 else 0 end + case when coalesce({0}.company, '') not in ('', 'חברה חסויה') then 15 else 0 end + least(40, floor(length(coalesce({0}.description, '')) / 120)))"


@_query(f"""with recursive v as (select *, k // 5 as g, k % 5 as i from ({VARIANTS.sql})), v1 as (select *, row_number() over (partition by g order by k) as rn, count(*) over (partition by g) as n from v),
f as (select g, rn, n, k, company, location, "locationKey", description, note from v1 where rn = 1 union all
  select g, rn, n, pk_, case when coalesce(pc, '') in ('', 'חברה חסויה') and coalesce(lc, '') not in ('', 'חברה חסויה') then lc else coalesce(pc, pc) end, case when move then ll else pl end, case when move then lk else pk end, case when length(coalesce(ld, '')) > length(coalesce(pd, '')) then ld else pd end, coalesce(pn, ln) from (
    select f.g, b.rn, f.n, case when wins then b.k else f.k end as pk_, wins, case when wins then not coalesce({_REAL.format('b')}, false) and coalesce({_REAL.format('f')}, false) else not coalesce({_REAL.format('f')}, false) and coalesce({_REAL.format('b')}, false) end as move,
      case when wins then b.company else f.company end as pc, case when wins then f.company else b.company end as lc, case when wins then b.location else f.location end as pl, case when wins then f.location else b.location end as ll,
      case when wins then b."locationKey" else f."locationKey" end as pk, case when wins then f."locationKey" else b."locationKey" end as lk, case when wins then b.description else f.description end as pd, case when wins then f.description else b.description end as ld,
      case when wins then b.note else f.note end as pn, case when wins then f.note else b.note end as ln
    from (select f.*, {_QUALITY.format('b')} > {_QUALITY.format('f')} as wins from f join v1 b on b.g = f.g and b.rn = f.rn + 1) f join v1 b on b.g = f.g and b.rn = f.rn + 1))
select k, company, location, "locationKey", length(description) as description_length, note from f where rn = n""")
def variant_fold_merge(spark, sf_dir):
    rows = VARIANTS.rows(spark, sf_dir).withColumns({"ingest_seq": c("k"), "id": c("k").cast("string"), "url": F.concat(F.lit("https://x.example/?JobID="), F.expr("k div 5")), "foundAt": F.lit(None).cast("timestamp")})
    from .flows import blocked_location, real_location

    return merge.merge_variants(rows, real_location, blocked_location).select("k", "company", "location", "locationKey", F.length("description").alias("description_length"), "note")


@_query(f"""with v as (select *, case when k % 3 = 0 then 'AllJobs' else 'Drushim' end as s, coalesce(nullif("locationKey", ''), location) as place, "fitScore" as n from ({ROLES.sql})),
x as (select k, n, row_number() over (partition by coalesce(case when s = 'AllJobs' then 'alljobs:' || (k // 4) end, lower(concat_ws('|', nullif(title, ''), nullif(company, ''), nullif(replace(place, '_', ' '), ''), nullif(replace("roleType", '_', ' '), '')))) order by n desc, k) as rn from v)
select k, n as "fitScore" from x where rn = 1""")
def dedupe_fingerprint_key(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).withColumns({"ingest_seq": c("k"), "source": F.when(c("k") % 3 == 0, "AllJobs").otherwise("Drushim"), "url": F.concat(F.lit("https://x.example/?JobID="), F.expr("k div 4"))})
    return dedupe.dedupe_fingerprints(rows).select("k", "fitScore")


@_query(f"""with v as (select *, case recommendation when 'apply' then 300 when 'review' then 200 else 0 end + case when coalesce("locationKey", '') <> '' then 25 else 0 end + "fitScore" as rank_,
  case when k % 3 = 0 then 'alljobs:' || (k // 4) else lower(source) || ':' || lower(title) || '|' || lower(coalesce(company, '')) || '|' || lower(coalesce(nullif("locationKey", ''), location)) end as key from ({ROLES.sql})),
x as (select *, row_number() over (partition by key order by rank_ desc, k) as rn from v) select k, recommendation from x where rn = 1""")
def dedupe_store_key(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir).withColumns({"ingest_seq": c("k"), "url": F.when(c("k") % 3 == 0, F.concat(F.lit("https://x.example/?JobID="), F.expr("k div 4"))).otherwise("")})
    return dedupe.dedupe_store(rows).select("k", "recommendation")


@_query(f"""with v as (select *, coalesce(url, '') <> '' as has, length(title) as len from ({AUDIT.sql})), x as (select *, row_number() over (partition by lower(concat_ws('|', title, company, location)) order by has desc, len desc, k) as rn from v) select k from x where rn = 1""")
def dedupe_digest_key(spark, sf_dir):
    return dedupe.dedupe_digest(AUDIT.rows(spark, sf_dir).withColumns({"ingest_seq": c("k"), "description": c("title")})).select("k")


# the pairwise rule of replacing, folded in input order
@_query(f"""with v as (select k, title as key, coalesce(kept, false) as digest, k % 4 = 1 as split, coalesce(length(company), 0) as len from ({AUDIT.sql})),
g as (select list({{'k': k, 'd': digest and not split, 's': split, 'n': len}} order by k) as rows from v where key <> '' group by key)
select list_reduce(rows, lambda a, b: case when (a.d and not b.d) or (not a.s and b.s) or (a.d = b.d and a.s = b.s and b.n > a.n) then b else a end).k as k from g""")
def dedupe_mail_candidates(spark, sf_dir):
    rows = AUDIT.rows(spark, sf_dir).select("k", c("k").alias("ingest_seq"), c("title").alias("reviewKey"), c("kept").alias("gmailDigest"), (c("k") % 4 == 1).alias("gmailDigestSplit"), c("company").alias("description"))
    return dedupe.dedupe_mail_candidates(rows).select("k")


@_query("select cast(n_nationkey as bigint) as id, case when n_nationkey % 3 = 0 then 'new ' || n_name else n_name end as name from nation")
def dimension_replace_by_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"))
    new = rows.where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name"))
    return dedupe.replace_by_id(rows, new)


#: Mails; some are about jobs, some are digests in the labelled form.
MAILS = Made("orders", "o_orderkey", [
    ("title", "string", 1, ["Your job alert", "Login code", "", "Invoice 7", "weekly news"]), ("sender", "string", 2, ["AllJobs <a@alljobs.co.il>", "Jobs at Indeed <x@indeed.com>", "\"Ann\" <ann@z.example>"]), ("snippet", "string", 3, ["hiring in חיפה", "remote jobs", "hello", None]),
    ("bodyText", "string", 5, ["", None, "חברה: x"]), ("link", "string", 7, ["https://www.alljobs.co.il/?JobID=5", "https://il.indeed.com/view?jk=a1", "https://x.example/unsubscribe", "https://x.example/a?b#c", ""]),
])


def _mails(spark, sf_dir) -> DataFrame:
    rows = MAILS.rows(spark, sf_dir).withColumn("links", F.filter(F.array("link", F.lit("https://il.indeed.com/view?jk=a1&q=2")), lambda x: x != ""))
    return rows.withColumns({"gmailMessageId": c("k").cast("string"), "threadId": c("k").cast("string"), "date": c("k")})


@_query(f"""with m as ({MAILS.sql}) select k, title in ('Login code', 'Invoice 7') as no_job, (contains(lower(sender), 'alljobs.co.il') or contains(link, 'alljobs.co.il')) and (title = 'Your job alert' or contains(sender, 'Jobs') or snippet in ('hiring in חיפה', 'remote jobs') or contains(sender, 'AllJobs')
  or contains(link, 'alljobs')) and title <> 'Invoice 7' as job_mail,
  case when sender like 'AllJobs%' then 'AllJobs' when sender like 'Jobs%' then 'Jobs at Indeed' else 'Ann' end as sender_name, case when contains(coalesce(snippet, ''), 'חיפה') then 'חיפה' when contains(coalesce(snippet, ''), 'remote') then 'Remote' else '' end as place from m""")
def mail_predicates(spark, sf_dir):
    return _mails(spark, sf_dir).select("k", mail.no_job_mail().alias("no_job"), mail.job_mail(["alljobs.co.il"]).alias("job_mail"), mail.sender_name(c("sender")).alias("sender_name"), mail.mail_location().alias("place"))


@_query(f"""with m as ({MAILS.sql}) select k, case when contains(link, 'JobID') then link || ' https://il.indeed.com/view?jk=a1&q=2' when contains(link, 'jk=') then link else 'https://il.indeed.com/view?jk=a1&q=2' end as links,
  case when contains(link, 'JobID') then 'https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID=5' else link end as url from m""")
def mail_links(spark, sf_dir):
    return _mails(spark, sf_dir).select("k", F.array_join(mail.job_links(c("links")), " ").alias("links"), mail.posting_url(c("link")).alias("url"))


_DIGEST = [
    "חדש! חברה: Acme מקום העבודה: Haifa סוג משרה: Full",
    "Tester חברה: Acme מקום העבודה: Haifa סוג משרה: Full דרישות: java לצפייה במשרה Clerk חברה: Bolt מקום העבודה: Nesher סוג משרה: Part לצפייה במשרה",
    "no blocks here",
]
DIGESTS = Made("orders", "o_orderkey", [("bodyText", "string", 1, _DIGEST)])


@_query(f"""with m as ({DIGESTS.sql}), p as (select * from (values ({_DIGEST[1]!r}, 1, 'Tester', 'Acme', 'Haifa', 'Full', 'דרישות: java'), ({_DIGEST[1]!r}, 2, 'Clerk', 'Bolt', 'Nesher', 'Part', '')) t("bodyText", piece, title, company, location, "jobType", description))
select k, cast(piece as integer) as piece, title, company, location, "jobType", description from m join p using ("bodyText")""")
def mail_digest_split(spark, sf_dir):
    rows = DIGESTS.rows(spark, sf_dir).select("k", F.posexplode(mail.digest_blocks(c("bodyText"))).alias("at", "b"))
    return rows.select("k", (c("at") + 1).alias("piece"), *(c(f"b.{n}").alias(n) for n in ("title", "company", "location", "jobType", "description")))


@_query(f"""with j as (select *, k % 5 = 0 as digest, k % 2 = 0 as alljobs from ({ROLES.sql})), n as (select k from j where k % 7 = 0)
select k from j where status in ('applied', 'saved') or not ((digest and cast(k // 3 as varchar) in (select cast(k as varchar) from n where k % 2 = 0)) or (alljobs and cast(k // 3 as varchar) in (select cast(k as varchar) from n)))""")
def mail_digest_replace(spark, sf_dir):
    rows = ROLES.rows(spark, sf_dir)
    jobs = rows.withColumns({"gmailDigest": c("k") % 5 == 0, "source": F.when(c("k") % 2 == 0, "Gmail · AllJobs").otherwise("Gmail"), "gmailMessageId": F.expr("cast(k div 3 as string)"), "url": F.lit(""), "title": c("k").cast("string")})
    new = rows.where("k % 7 = 0").withColumns({"gmailMessageId": c("k").cast("string"), "gmailDigestSplit": c("k") % 2 == 0, "url": F.lit(""), "title": F.lit("none")})
    return mail.without_replaced(jobs, new).select("k")


@_query("select cast(o_orderkey as varchar) as \"gmailMessageId\" from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 40)")
def incremental_unprocessed(spark, sf_dir):
    mails = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderkey").cast("string").alias("gmailMessageId"))
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 40").select(c("l_orderkey").cast("string").alias("gmailMessageId"))
    return mail.unprocessed(mails, done)


@_query(f"""with j as (select *, coalesce(kept, false) as digest, exists (select 1 from (values ('review')) v(x) where x = recommendation) as rv, k % 4 = 0 as learned, k % 9 = 0 as split from ({AUDIT.sql})),
a as (select *, case when learned then least(coalesce("fitScore", 0), 75) else coalesce("fitScore", 0) end as n, case when learned then 'review' else recommendation end as r, digest and not split as forced from j),
b as (select *, forced or r = 'skip' or n < 45 as manual from a)
select k, case when forced then least(greatest(n, 50), 65) when manual then greatest(n, 50) else n end as "fitScore", case when manual then 'review' else r end as recommendation from b""")
def mail_route_to_review(spark, sf_dir):
    rows = AUDIT.rows(spark, sf_dir).withColumns({"gmailDigest": c("kept"), "gmailDigestSplit": c("k") % 9 == 0, "warnings": F.when(c("k") % 4 == 0, F.array(F.lit("למידה: בעבר פסלת"))), "status": F.lit("found")})
    return mail.route_to_review(rows).select("k", "fitScore", "recommendation")


#: Stored postings of many states and sources.
STORED = Made("part", "p_partkey", [
    ("status", "string", 1, ["found", "applied", "saved", "archived", "rejected", "interview", "skipped", None, ""]), ("source", "string", 2, ["Gmail · AllJobs", "Drushim", "gmail Indeed", None, "Gmail"]), ("recommendation", "string", 2, ["apply", "review", None]),
    ("gmailDigest", "boolean", 5, [True, False, None]), ("title", "string", 7, ["X · AllJobs #2", "Plain", "תקציר משרות"]), ("fitScore", "int", 1, [None, 10, 56, 71, 86]), ("company", "string", 4, ["Acme", "", None]),
])


@_query(f"""with s as (select * from ({STORED.sql}) where contains(lower(source), 'gmail')) select count(*) as "gmailJobsTotal", count(*) filter (where coalesce(nullif(status, ''), 'found') not in ('saved', 'applied', 'interview', 'archived', 'rejected', 'skipped')) as "activeGmailJobs",
  count(*) filter (where recommendation = 'review') as "reviewGmailJobs", count(*) filter (where status in ('applied', 'interview')) as "appliedGmailJobs", count(*) filter (where status = 'saved') as "savedGmailJobs", count(*) filter (where "gmailDigest") as "digestJobs",
  count(*) filter (where contains(title, '#')) as "fakeSplitJobs" from s""")
def agent_summary(spark, sf_dir):
    return summary.agent_summary(STORED.rows(spark, sf_dir))


@_query(f"""with s as (select *, case when k % 2 = 0 then date '2024-01-15' else date '2024-01-01' end as day from ({STORED.sql})), t as (select *, coalesce(nullif(status, ''), 'found') = 'found' as waiting, coalesce(status in ('applied', 'interview'), false) as ap from s)
select count(*) filter (where waiting) as total, count(*) filter (where waiting and recommendation = 'apply') as apply, count(*) filter (where ap) as applied, count(*) filter (where status = 'saved') as saved, count(*) filter (where status in ('archived', 'rejected', 'skipped')) as archived,
  count(*) filter (where ap and day = date '2024-01-15') as "appliedToday", count(*) filter (where contains(lower(source), 'gmail')) as "gmailJobs" from t""")
def dashboard_counts(spark, sf_dir):
    at = F.when(c("k") % 2 == 0, F.lit("2024-01-15")).otherwise("2024-01-01").cast("timestamp_ntz")
    return summary.dashboard(STORED.rows(spark, sf_dir).withColumns({"updatedAt": at, "appliedAt": F.lit(None).cast("timestamp_ntz")}), F.lit("2024-01-15").cast("date"))


@_query(f"select case when source like '%·%' then 'AllJobs' when source = 'gmail Indeed' then 'Indeed' when source = 'Drushim' then 'Drushim' else 'Gmail' end as source, count(*) as n from ({STORED.sql}) group by 1")
def mail_sources(spark, sf_dir):
    return summary.count_by(STORED.rows(spark, sf_dir), summary.mail_source(c("source")), name="source")


@_query(f"""with s as ({STORED.sql}) select (select count(*) from s) as incoming, (select count(*) from s where "fitScore" is not null) as scored, (select count(*) from s where status = 'saved') as kept, greatest(0, (select count(*) from s where "fitScore" is not null) - (select count(*) from s where status = 'saved')) as filtered""")
def scan_totals(spark, sf_dir):
    rows = STORED.rows(spark, sf_dir)
    return summary.scan_totals(rows, rows.where("fitScore is not null"), rows.where("status = 'saved'"))


@_query("select p_partkey, case when p_size % 5 = 0 then 0 else cast(floor(100.0 * (p_partkey % 7) / (p_size % 5) + 0.5) as integer) end as percent from part")
def progress_percent(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", summary.percent(c("p_partkey") % 7, c("p_size") % 5).alias("percent"))


@_query(f"""with s as ({STORED.sql}), t as (select 'waiting' as tab, k from s where coalesce(nullif(status, ''), 'found') = 'found' union all select 'applied', k from s where status in ('applied', 'interview') union all select 'saved', k from s where status = 'saved'
  union all select 'archive', k from s where status in ('archived', 'rejected', 'skipped')) select tab, count(*) as n, sum(k) as keys from t group by tab""")
def search_tabs(spark, sf_dir):
    rows = STORED.rows(spark, sf_dir)
    parts = [rows.where(search.tab(name)).agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys")) for name in ("waiting", "applied", "saved", "archive")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query(f"""with s as (select *, coalesce(recommendation = 'review', false) as rv from ({STORED.sql})), t as (select 'all' as mode, k from s union all select 'apply', k from s where status = 'found' and not rv union all select 'review', k from s where status = 'found' and rv
  union all select 'digest', k from s where "gmailDigest" or contains(title, 'תקציר משרות') union all select 'archived', k from s where status in ('archived', 'rejected')) select mode, count(*) as n, sum(k) as keys from t group by mode""")
def agent_filters(spark, sf_dir):
    rows, out = STORED.rows(spark, sf_dir), None
    for mode in ("all", "apply", "review", "digest", "archived"):
        part = rows.where(search.agent_filter(mode)).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


@_query(f"""select k, row_number() over (order by coalesce("fitScore", 0) desc, k) as by_score, row_number() over (order by case when status = 'found' and recommendation = 'apply' then 0 when status = 'found' and recommendation = 'review' then 1 when status = 'saved' then 2 when status = 'applied' then 3 else 4 end, coalesce("fitScore", 0) desc, k) as by_agent
from ({STORED.sql}) where k <= 200 order by k""".replace("where k <= 200 ", ""))
def sort_orders(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = STORED.rows(spark, sf_dir).withColumn("ingest_seq", c("k"))
    place = lambda order: F.row_number().over(Window.orderBy(*order)).cast("long")  # noqa: E731  the sort itself is the feature
    return rows.select("k", place(search.sort_order("score-desc")).alias("by_score"), place([*search.agent_order(), c("k").asc()]).alias("by_agent"))


@_query(f"""select k, "fitScore", status from ({STORED.sql}) where contains(lower(concat_ws(' ', title, company, source)), 'acme') and coalesce("fitScore", 0) >= 70 and coalesce("fitScore", 0) < 85 and source = 'Drushim' and coalesce(nullif(status, ''), 'found') = 'found'""")
def faceted_search_all(spark, sf_dir):
    return search.search(STORED.rows(spark, sf_dir), search.Facets(term="Acme ", band="good", source="Drushim", status="found")).select("k", "fitScore", "status")


#: Provider rows as they land.
LANDED = Made("part", "p_partkey", [
    ("title", "string", 1, ["QA Engineer", "Clerk", "", None]), ("company", "string", 2, ["Acme", "", None]), ("location", "string", 3, ["Haifa", "Haifa סוג משרה: full", "", None, "x" * 90]), ("description", "string", 5, ["text", None]),
    ("link", "string", 7, ["https://www.jobs.acme.example/a", "", None, "https://x.example/?JobID=9"]), ("sourceQuery", "string", 11, ["qa", "data"]), ("source", "string", 13, ["Bolt", ""]), ("snippet", "string", 3, ["s", None]), ("sourceName", "string", 5, ["Board", ""]), ("via", "string", 7, ["V", None]),
])
_FROM_LINK = "case when contains(link, 'acme') then 'jobs' else 'x' end"


@_query(f"""with l as (select * from ({LANDED.sql}) where coalesce(title, '') <> '' and coalesce(link, '') <> ''), place as (select *, case when coalesce(location, '') = '' then 'Israel' else location end as own,
  case when coalesce(location, '') = '' or length(location) > 80 then 'Israel' else 'Haifa' end as cleaned from l)
select 'AllJobs' as source, coalesce(nullif(company, ''), 'AllJobs') as company, cleaned as location, coalesce(description, '') as description, 'AllJobs' as via, link as url, title, "sourceQuery" from place
union all select 'Drushim', coalesce(nullif(company, ''), 'Drushim'), own, coalesce(description, ''), 'Drushim', link, title, "sourceQuery" from place union all select 'Matrix', 'Matrix', own, coalesce(description, ''), 'Matrix', link, title, "sourceQuery" from place
union all select coalesce(nullif("sourceName", ''), 'Site'), coalesce(nullif(company, ''), {_FROM_LINK}), own, coalesce(description, ''), coalesce(via, 'Site'), link, title, "sourceQuery" from place
union all select 'Google', coalesce(nullif(source, ''), {_FROM_LINK}), 'Israel', coalesce(snippet, ''), 'Google', link, title, "sourceQuery" from place union all select 'Playwright', {_FROM_LINK}, 'Israel', '', 'Playwright', link, title, "sourceQuery" from place""")
def provider_rows(spark, sf_dir):
    rows = LANDED.rows(spark, sf_dir)
    out = providers.collected({p: rows for p in ("alljobs", "drushim", "matrix", "sites", "serpapi", "playwright")}, F.lit("2024-01-01").cast("timestamp"))
    return out.select("source", "company", "location", "description", "via", "url", "title", "sourceQuery")


@_query(f"""with s as ({STORED.sql}), r as (select source, count(*) as raw from s where source is not null group by 1), n as (select source, count(*) as normalized from s where source like 'G%' group by 1), x as (select source, count(*) as scored from s where source = 'Drushim' group by 1)
select source, coalesce(raw, 0) as raw, coalesce(normalized, 0) as normalized, coalesce(scored, 0) as scored from r full join n using (source) full join x using (source)""")
def provider_counts(spark, sf_dir):
    rows = STORED.rows(spark, sf_dir).where("source is not null")
    return providers.provider_counts(rows, rows.where("source like 'G%'"), rows.where("source = 'Drushim'"))


@_query("""
with p as (select page_id, url, case when url like 'https://%' then substr(url, 9) else substr(url, 8) end as rest from pages), h as (select *, regexp_extract(rest, '^([^/?#]+)', 1) as hn from p)
select page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) as plain, split_part(regexp_replace(lower(hn), '^www\\.', ''), '.', 1) as company, regexp_replace(lower(hn), '^www\\.', '') in ('example.com') or lower(hn) like '%.example.com' as within_com from h
""")
def url_parts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    from ..functions.urls import host_within

    return pages.select("page_id", normalized_url(c("url")).alias("plain"), company_from_link(c("url")).alias("company"), host_within(host(c("url")), F.lit("example.com")).alias("within_com"))


LINKS = Made("part", "p_partkey", [("link", "string", 1, ["/a/b", "//c.example/x", "https://d.example/?JobID=12&x=1", "HTTP://e.example", "", None, "https://www.drushim.co.il/job/77/x", "https://www.jobmaster.co.il/?key=5", "b/c"])])


@_query(f"""with l as (select k, coalesce(link, '') as u from ({LINKS.sql})) select k, case when u = '' then '' when lower(u) like 'http%' then u when u like '//%' then 'https:' || u else 'https://base.example/' || ltrim(u, '/') end as absolute,
  case when contains(u, 'JobID') then 'alljobs:12' when contains(u, 'drushim') then 'drushim:77' when contains(u, 'jobmaster') then 'jobmaster:5' end as provider_key from l""")
def links_and_ids(spark, sf_dir):
    return LINKS.rows(spark, sf_dir).select("k", absolute(c("link"), "https://base.example/").alias("absolute"), provider_key(c("link"), ["alljobs", "drushim", "jobmaster"]).alias("provider_key"))


@_query(r"""with l as (select page_id, list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), lambda x: regexp_replace(trim(replace(x, '&amp;', '&')), '[),.;\]]+$', '')) as x from pages),
d as (select page_id, list_filter(x, lambda u, i: starts_with(u, 'http') and list_position(x, u) = i) as u from l) select page_id, len(u) as n, array_to_string(u, ' ') as links from d""")
def unique_page_links(spark, sf_dir):
    from ..functions.urls import links_in_html

    found = unique_links(links_in_html(c("html")), 10_000)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("links"))


WORDS = Made("part", "p_partkey", [("a", "string", 1, ["x, y,, z", "", None, " one "]), ("b", "string", 1, [" ONE", "one", "", None, "One "]), ("n", "string", 1, ["12", "0", "1.5", "no", None, ""]), ("t", "string", 1, ["5+ years", "experience of 3", "2 yrs", "none", None, "6 שנים"])])


@_query(f"""with w as ({WORDS.sql}) select k, case when a = 'x, y,, z' then 'x|y|z' when a = ' one ' then 'one' else '' end as parts, coalesce(trim(a) = 'one' and lower(trim(b)) = 'one', false) as same, cast(case n when '12' then 12 when '1.5' then 1.5 else 7 end as double) as number,
  coalesce(t in ('5+ years', '6 שנים'), false) as four_years, coalesce(b, '') as round_trip, case when contains(lower(coalesce(b, '')), 'one') then 'one' else '' end as hits from w""")
def text_helpers(spark, sf_dir):
    rows = WORDS.rows(spark, sf_dir)
    return rows.select("k", F.array_join(split_list(c("a")), "|").alias("parts"), same_text(c("a"), c("b")).alias("same"), number_or(c("n"), 7.0).alias("number"), years_at_least(c("t"), 4).alias("four_years"), or_else(unbase64url(base64url(F.coalesce(c("b"), F.lit("")))), F.lit("")).alias("round_trip"),
                       F.array_join(keyword_hits(c("b"), ["one", "xy", "a"]), "|").alias("hits"))


#: Texts that set off one rule each.
RULED = Made("part", "p_partkey", [
    ("title", "string", 1, ["QA Engineer", "Post", "Senior post", "Post junior", "Team lead"]), ("company", "string", 1, ["Acme", "Matrix", "", "x|y", "z" * 90, None]), ("location", "string", 2, ["Haifa", "Israel", None, "My Town"]), ("description", "string", 3, ["night shift", "call center", "", "מכירות", None, "a·Bolt·c"]),
    ("source", "string", 5, ["Drushim", "JobMaster", "AllJobs"]), ("sourceQuery", "string", 1, [""]),
])


@_query(f"""with r as ({RULED.sql}), s as (select *, coalesce(description, '') as d from r), f as (select k, contains(d, 'night') as sh, contains(d, 'call center') as ph, contains(title, 'Senior') or contains(title, 'lead') as se, contains(d, 'מכירות') as sa, contains(title, 'junior') as ne from s)
select k, sh as "hasShiftSignal", ph as "hasPhoneSignal", se as "hasSeniorSignal", sa as "hasSalesSignal", ne as "hasNoExperienceSignal", concat_ws(',', case when sh then 'shifts' end, case when ph then 'phone' end, case when se then 'senior' end, case when sa then 'sales' end) as bad from f""")
def posting_signals(spark, sf_dir):
    return enrich.signal_columns(RULED.rows(spark, sf_dir)).select("k", "hasShiftSignal", "hasPhoneSignal", "hasSeniorSignal", "hasSalesSignal", "hasNoExperienceSignal", F.array_join("badSignals", ",").alias("bad"))


@_query(f"""with r as ({RULED.sql}), s as (select *, source = 'Drushim' and coalesce(description, '') like 'a·%' as parts, coalesce(company, '') = 'Acme' as own from r)
select k, case when parts then 'Bolt' when own then 'Acme' else source end as company, case when parts then 'drushim_description_parts' when own then 'job_company' else 'fallback' end as "companyConfidence" from s""")
def company_choice(spark, sf_dir):
    return enrich.company_columns(RULED.rows(spark, sf_dir)).select("k", "company", "companyConfidence")


@_query(f"""with r as ({RULED.sql}) select k, case when location = 'Haifa' then 'haifa' when description = 'call center' then 'center' when location = 'My Town' then 'my_town' end as "locationKey", case when location = 'Haifa' or coalesce(description = 'call center', false) then 'matched_text' when location = 'My Town' then 'job_location' else 'unknown' end as "locationConfidence" from r""")
def location_choice(spark, sf_dir):
    return enrich.location_columns(RULED.rows(spark, sf_dir)).select("k", "locationKey", "locationConfidence")


PAGES = Made("part", "p_partkey", [
    ("title", "string", 1, ["משרות נוספות", "Post", "QA תוכנה", "דרושים בחיפה"]), ("company", "string", 2, ["JobMaster", "Acme"]), ("description", "string", 3, ["Post", "y" * 3100, "googletagmanager lpTag", "משרות נוספות", "z" * 12_001, None]), ("source", "string", 5, ["JobMaster", "Drushim"]),
])


@_query(f"""with p as (select *, coalesce(description, '') as d, source = 'JobMaster' as jm from ({PAGES.sql})) select k, length(d) > 12000 or d like 'google%' or (title = 'QA תוכנה' and length(d) > 3000) as dump,
  jm and (title = 'דרושים בחיפה' or (company = 'JobMaster' and d = title)) as category, jm and (title = 'משרות נוספות' or d = 'משרות נוספות' or (company = 'JobMaster' and d = '')) as noise from p""")
def page_guards(spark, sf_dir):
    rows = PAGES.rows(spark, sf_dir)
    four = [c(n) for n in ("source", "title", "company", "description")]
    return rows.select("k", enrich.page_dump(c("title"), c("description")).alias("dump"), enrich.category_page(*four).alias("category"), enrich.listing_noise(*four).alias("noise"))


@_query("""with h as (select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') as hn from pages), s as (select * from (values ('com', 'example.com', true), ('org', 'example.org', null), ('net', 'example.net', false)) s(id, domain, enabled))
select page_id, id from h join s on (hn = domain or hn like '%.' || domain) and enabled is distinct from false""")
def results_by_host(spark, sf_dir):
    sources = spark.createDataFrame([("com", "example.com", True), ("org", "example.org", None), ("net", "example.net", False)], "id string, domain string, enabled boolean")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return joins.by_host(pages.withColumn("host", host(c("url"))), sources, c("host")).select("page_id", "id")


@_query("select page_id, url from pages where contains(lower(url), 'casino') or contains(lower(url), 'free-bets')")
def trusted_texts(spark, sf_dir):
    return joins.trusted_mails(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), ["Casino", "free-bets"], c("url"))


@_query("""with a as (select c_custkey, string_split(c_name, '#') as l, string_split(c_mktsegment, 'I') as r from customer) select c_custkey, l[i] as l_item, r[i] as r_item from a, lateral (select unnest(generate_series(1, greatest(len(l), len(r)))) as i)""")
def zip_positions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.split("c_name", "#").alias("l"), F.split("c_mktsegment", "I").alias("r"))
    return joins.zip_by_position(rows, "l", "r").select("c_custkey", "l_item", "r_item")


@_query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
def new_vs_snapshot_anti(spark, sf_dir):
    snapshot = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return joins.new_rows(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), snapshot, "c_custkey")


@_query("""select o_custkey, last from (select o_custkey, max(o_orderdate) as last from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0 group by 1) order by last desc, o_custkey limit 500""")
def processed_newest(spark, sf_dir):
    from ..streaming.scan import processed_tail

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", c("o_orderdate").alias("last"))
    return processed_tail(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), "o_custkey", "last", 500)


@_query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1500")
def feedback_log_compacted(spark, sf_dir):
    from ..sources.tables import compacted_log

    return compacted_log(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts"), 1500, "ts", "event_id").drop("ts")
