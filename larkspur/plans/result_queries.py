"""Queries of provider results and of the mail agent over made tables (see made_tables), with SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.urls import without_redirect
from ..operators import agent, joins, line_digest, results, summary
from ..sources import providers
from .made_tables import Made

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Pieces of SQL: squeezed text, words, the first known place, tests of titles


def _sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _any(x: str, words: list[str]) -> str:
    return f"regexp_matches(coalesce({x}, ''), '{'|'.join(words)}')"


def _target(x: str) -> str:
    return _any(f"lower({x})", V.TARGET_ROLE_WORDS)


def _bad_title(x: str) -> str:
    return f"(length({_sq(x)}) not between 5 and 140 or regexp_matches({_sq(x)}, '^\\d+$|לפני\\s+\\d+') or {_any(_sq(x), V.BAD_TITLE_WORDS)})"


def _strong(x: str) -> str:
    return f"(not {_bad_title(x)} and {_any(f'lower({x})', V.STRONG_TITLE_WORDS)})"


def _known(x: str) -> str:
    return "coalesce(" + ", ".join(f"case when contains({x}, '{p}') then '{p}' end" for p in V.RESULT_PLACES) + ")"


def _place(value: str, text: str) -> str:
    alias = "case " + " ".join(f"when regexp_matches(p, '(?i){pattern.replace(chr(39), chr(39) * 2)}') then '{name}'" for pattern, name in V.PLACE_ALIASES) + " end"
    cut = f"trim(regexp_replace(regexp_replace({_sq(value)}, '{V.PLACE_CUT}', ''), '[·|:]+$', ''))"
    body = f"coalesce({alias}, {_known(f'''(p || ' ' || coalesce({text}, ''))''')}, case when p = '' or length(p) > 35 then 'Israel' else p end)"
    return f"(select {body} from (select {cut} as p))"


def _company(x: str) -> str:
    n = f"{_sq(f'''regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '^לעוד משרות ומידע על\\s*', ''), '^דרושים ב', ''), '>$', '')''')}"
    names = ", ".join(f"'{v}'" for v in V.NO_COMPANY_NAMES)
    return f"case when {n} in ('', {names}) or {_any(n, V.NO_COMPANY_WORDS)} then '{V.HIDDEN_COMPANY}' else {n}[:80] end"


#: Results of a search, and cards with their texts.
RESULTS = Made("part", "p_partkey", [
    ("title", "string", 1, ["QA tester", "Data analyst wanted", "בודקת תוכנה", "כל התחומים בודק", "Gardener", "תוכנה", None, "12345", "Night guard  with  data"]),
    ("company", "string", 2, ["Acme", "AllCourses Ltd", "חברה חסויה", "", None]),
    ("location", "string", 3, ["Haifa", "Israel", "", "לוד", "דרישות: כלום", "far away " * 8, None]),
    ("link", "string", 5, ["https://x.example/?JobID=7", "https://x.example/SearchResultsGuest.aspx?page=1", "", "https://x.example/SearchResultsGuest.aspx?JobID=9", "https://x.example/job/3", None]),
    ("description", "string", 7, ["", "short", "automation " * 12, "x" * 2600, None, "plain words " * 40]),
    ("query", "string", 11, ["qa haifa", "Guard lod", "בודק", "x y", "data", ""]),
])
CARDS = Made("part", "p_partkey", [
    ("card", "string", 1, ["דרישות · QA tester · Acme · חיפה", "שם המשרה: Night guard · חברה: Beta > · מיקום המשרה: Lod", "תפקיד: שכר · plain", "Location: Haifa · data entry clerk · מיקום המשרה", None, "דרושים בGamma · automation lead · AllJobs", "data entry clerk · תיאור כללי · נשר"]),
    ("link_text", "string", 2, ["", "QA  lead", "Gardener", None]),
    ("name", "string", 3, ["Acme", "AllJobs", "דרושים בDelta", "Data House", "לעוד משרות ומידע על Omega>", "", None, "מגייסת כללית"]),
    ("spot", "string", 5, ["Haifa, north", "Nowhere סוג משרה: מלאה", "x" * 40, "", None, "Yokneam", "ramat gan|", "Lod·"]),
    ("about", "string", 1, ["", "ליד נתניה", None, "בחיפה"]),
])

_SEARCH = "(contains(lower(coalesce(link, '')), 'searchresultsguest.aspx') and not regexp_matches(lower(coalesce(link, '')), 'jobid=|jobid%3d'))"
_BAD = f"""(length({_sq('title')}) < 5 or {_any(_sq('title'), V.RESULT_BAD_TITLES)} or (contains({_sq('title')}, 'תוכנה') and length({_sq('title')}) <= 8) or {_any(_sq('company'), V.RESULT_BAD_COMPANIES)}
  or length({_sq('location')}) > 60 or regexp_matches({_sq('location')}, '(?i)דרישות|Requirements|Show\\s*more') or ({_SEARCH} and length({_sq('description')}) < 120) or not {_target(f"{_sq('title')} || ' ' || {_sq('description')}")})"""
_JUDGED = f"""with r as ({RESULTS.sql}), j as (select *, {_BAD} as bad,
  case when regexp_matches(coalesce(link, ''), '(?i)JobID=\\d+') then 25 else 0 end + case when {_SEARCH} then 0 else 10 end + case when coalesce(company, '') not in ('', '{V.HIDDEN_COMPANY}') then 6 else 0 end + case when coalesce(location, '') not in ('', 'Israel') then 6 else 0 end
  + case when {_target("coalesce(title, '')")} then 12 else 0 end + case when length(coalesce(description, '')) >= 120 then 5 else 0 end - case when length(coalesce(description, '')) > 2500 then 5 else 0 end as points,
  case when regexp_matches(coalesce(link, ''), '(?i)[?&]jobid=\\d+') then 'alljobs-jobid-' || regexp_extract(link, '(?i)[?&]jobid=(\\d+)', 1) else array_to_string([x for x in [lower({_sq('title')}), lower({_sq('company')}), lower({_sq('location')})] if x <> ''], '|') end as key from r)
"""


@_query(_JUDGED + "select k, bad, points - case when bad then 100 else 0 end as points, key from j")
def result_quality(spark, sf_dir):
    five = [c(n) for n in ("title", "company", "location", "link", "description")]
    return RESULTS.rows(spark, sf_dir).select("k", results.bad_result(*five).alias("bad"), results.candidate_score(*five).alias("points"), results.result_key(*five[:4]).alias("key"))


@_query(_JUDGED + "select k, position from (select k, row_number() over (partition by key order by points desc, k) as nth, min(k) over (partition by key) as position from j where not bad) where nth = 1")
def results_best_candidate(spark, sf_dir):
    return results.unique_results(RESULTS.rows(spark, sf_dir), "k").select("k", "position")


@_query(f"""with r as ({RESULTS.sql}), t as (select k, lower(coalesce(query, '')) as q, lower(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(description, '')) as t from r)
select k, case when {_any('q', V.QA_QUERY_WORDS)} then {_any('t', V.QA_RESULT_WORDS)} else len([w for w in string_split_regex(q, '\\s+') if length(w) >= 2 and contains(t, w)]) > 0 end as relevant from t""")
def result_relevance(spark, sf_dir):
    return RESULTS.rows(spark, sf_dir).select("k", results.relevant_to(*(c(n) for n in ("query", "title", "company", "location", "description"))).alias("relevant"))


@_query(f"""with r as ({CARDS.sql}), p as (select *, coalesce(card, '') as t, {_sq('link_text')} as own, [x for x in [trim(y) for y in string_split(coalesce(card, ''), '·')] if x <> ''] as parts,
  coalesce(nullif(regexp_extract(coalesce(card, ''), 'שם המשרה:\\s*([^·]+)', 1), ''), nullif(regexp_extract(coalesce(card, ''), 'תפקיד:\\s*([^·]+)', 1), '')) as said,
  coalesce(nullif(regexp_extract(coalesce(card, ''), 'חברה:\\s*([^·]+)', 1), ''), nullif(regexp_extract(coalesce(card, ''), 'דרושים ב([^·]+)', 1), '')) as firm from r),
a as (select *, coalesce(case when not {_bad_title('own')} and {_target('own')} then own end, case when not {_bad_title('said')} then {_sq('said')} end, [x for x in parts if not {_bad_title('x')} and {_target('x')}][1], '') as title from p),
b as (select *, list_position([contains(x, title) for x in parts], true) as found from a), d as (select *, case when found > 0 then parts[found + 1] end as after from b)
select k, title, {_company(f"coalesce(firm, case when length(after) between 2 and 80 and not {_any('after', V.COMPANY_AFTER_TITLE_BARRED)} then after end)")} as company,
  {_sq(f"coalesce(nullif(regexp_extract(t, 'מיקום המשרה:\\s*([^·]+)', 1), ''), nullif(regexp_extract(t, '(?i)Location:\\s*([^·]+)', 1), ''), {_known('t')}, 'Israel')")} as place from d""")
def card_choices(spark, sf_dir):
    rows = CARDS.rows(spark, sf_dir).withColumn("title", results.chosen_title(c("card"), c("link_text")))
    return rows.select("k", "title", results.chosen_company(c("card"), c("title")).alias("company"), results.chosen_place(c("card")).alias("place"))


@_query(f"""with r as ({CARDS.sql}), n as (select *, {_company('name')} as company from r)
select k, company, company <> '{V.HIDDEN_COMPANY}' and length(company) between 2 and 60 and not regexp_matches(company, '(?i){V.NO_COMPANY_TEXT[0]}') and not {_target('company')} as useful, {_place('spot', 'about')} as place from n""")
def card_cleanup(spark, sf_dir):
    return CARDS.rows(spark, sf_dir).select("k", results.clean_company(c("name")).alias("company"), results.useful_company(c("name")).alias("useful"), results.clean_place(c("spot"), c("about")).alias("place"))


_PAGE = ("https://x.example/?JobID=7", ["» · Start", "תוכנה · QA engineer » more"], "About us · חברה: Omega · מיקום: tel aviv · " + "work with data " * 20)


@_query(f"""with r as ({RESULTS.sql}), w as (select k from r where regexp_matches(coalesce(link, ''), '(?i)[?&]JobID=\\d+') and (coalesce(location, '') in ('', 'Israel') or length(location) > 35 or contains(location, 'דרישות') or company = '{V.HIDDEN_COMPANY}' or length(coalesce(description, '')) < 350) order by k limit 80),
p as (select *, k in (select k from w) and coalesce(link, '') = '{_PAGE[0]}' as page, trim('{_PAGE[2]}') as body from r)
select k, case when page and not {_strong('title')} then 'QA engineer' when page then {_sq('title')} else title end as title, case when page then 'Omega' else company end as company, case when page then 'תל אביב' else location end as location,
  case when not page then description when length(body) < length({_sq('description')}) then {_sq('description')} else body end as description, page as fetched from p""")
def result_details(spark, sf_dir):
    pages = spark.createDataFrame([_PAGE], "link string, headings array<string>, body string")
    rows = results.with_details(RESULTS.rows(spark, sf_dir), pages, seq_col="k")
    return rows.select("k", "title", "company", "location", "description", c("detailsFetched").alias("fetched"))


@_query("""with e as (select l_orderkey as search, l_linenumber as page, count_if(l_discount >= 0.06) as relevant, count_if(l_tax >= 0.06) as added from lineitem group by all),
p as (select *, row_number() over (partition by search order by page) as place from e),
n as (select *, max(case when relevant > 0 then place end) over w as hit, max(case when added > 0 then place end) over w as fresh from p window w as (partition by search order by page)),
s as (select *, min(case when place - coalesce(hit, 0) >= 2 or place - coalesce(fresh, 0) >= 5 then place end) over (partition by search) as stop from n)
select search, page from s where stop is null or place <= stop""")
def search_page_stops(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hits = lambda n: F.count_if(c(n) >= 0.06)
    pages = lines.groupBy(c("l_orderkey").alias("search"), c("l_linenumber").alias("page")).agg(hits("l_discount").alias("relevant"), hits("l_tax").alias("added"))
    return results.pages_read(pages).select("search", "page")


# The mail agent

SETTINGS = Made("customer", "c_custkey", [
    ("id", "string", 1, [None, "", "My Role/One", "_x_", "é"]), ("name", "string", 2, ["Night Guard", " Data ", "בודק תוכנה"]), ("roleFamily", "string", 3, [None, " ", "qa"]), ("roleType", "string", 5, [None, "kind"]),
    ("least", "double", 7, [None, 0.0, 61.5]), ("bonus", "double", 3, [None, 4.0]), ("enabled", "boolean", 2, [None, True, False]), ("queries", "string", 3, ["", "a, b", " , "]), ("positive", "string", 5, ["", "p ,q"]),
    ("domains", "string", 7, ["Example.com", "@a.example, b.example,A.example", "x.example,,"]), ("notes", "string", 11, [None, " n "]),
])
_LIST = "[y for y in [trim(x) for x in string_split({}, ',')] if y <> '']"
_ID = "nullif(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(nullif(id, ''), name))), '[\\s/\\\\]+', '_', 'g'), '[^a-z0-9_א-ת-]', '', 'g'), '^_+|_+$', '', 'g'), '')"


@_query(f"""with r as ({SETTINGS.sql}), s as (select *, {_ID} as key, trim(name) as n, {_LIST.format('queries')} as q, {_LIST.format('positive')} as p from r)
select k, key as id, n as name, coalesce(enabled, true) as enabled, coalesce(nullif(trim("roleFamily"), ''), 'custom') as "roleFamily", coalesce("roleType", key) as "roleType", coalesce(least, 58) as least, coalesce(bonus, 28) as bonus,
  array_to_string(case when len(q) > 0 then q else [n || ' חיפה', n || ' צפון'] end, ';') as queries, array_to_string(case when len(p) > 0 then p else [n] end, ';') as positive from s""")
def role_profile_defaults(spark, sf_dir):
    rows = SETTINGS.rows(spark, sf_dir)
    split = lambda n: F.split(n, ",")
    given = rows.select(F.struct("k").alias("of"), "id", "name", "enabled", "roleFamily", "roleType", c("least").alias("mainListMinScore"), c("bonus").alias("scoreBonus"), split("queries").alias("queries"), split("positive").alias("positivePatterns"), F.lit(None).cast("array<string>").alias("negativePatterns"))
    # the operator returns profiles alone: the row's number rides along in the negative patterns
    given = given.withColumn("negativePatterns", F.array(c("of.k").cast("string"))).drop("of")
    out = agent.role_profiles(given)
    return out.select(F.get("negativePatterns", F.lit(0)).cast("long").alias("k"), "id", "name", "enabled", "roleFamily", "roleType", c("mainListMinScore").alias("least"), c("scoreBonus").alias("bonus"), F.array_join("queries", ";").alias("queries"), F.array_join("positivePatterns", ";").alias("positive"))


@_query(f"""with r as ({SETTINGS.sql}), s as (select trim(name) as n, enabled, trim(coalesce(notes, '')) as notes, regexp_replace(regexp_replace(lower(trim(coalesce(id, trim(name)))), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') as key, domains from r)
select nullif(key, '') as id, n as name, coalesce(enabled, true) as enabled, notes, case domains when 'Example.com' then 'example.com' when 'x.example,,' then 'x.example' else 'a.example;b.example' end as domains, count(*) as n from s group by all""")
def trusted_sender_defaults(spark, sf_dir):
    out = agent.trusted_senders(SETTINGS.rows(spark, sf_dir)).withColumn("domains", F.array_join("domains", ";"))
    return out.groupBy("id", "name", "enabled", "notes", "domains").agg(F.count(F.lit(1)).alias("n"))


TERMS = Made("part", "p_partkey", [("term", "string", 1, ["QA", "a", "12345", " Jobs ", '"junior"', "https://x.example", "data  entry", None, "תוכנה", "x" * 49, "x" * 48])])


@_query(f"""with r as ({TERMS.sql}), t as (select k, lower({_sq("translate(term, '\"“”', '')")}) as t from r)
select k, length(t) between 2 and 48 and not {_any('t', [f'^{w}$' for w in V.TOO_BROAD_TERMS])} and not regexp_matches(t, '^https?:|^[0-9]+$') as useful from t""")
def mail_search_terms(spark, sf_dir):
    return TERMS.rows(spark, sf_dir).select("k", agent.useful_term(c("term")).alias("useful"))


MAILS = Made("orders", "o_orderkey", [
    ("subject", "string", 1, ["New  job", None, ""]), ("sender", "string", 2, ["a@x.example", None]), ("snippet", "string", 3, [None, " short  text ", ""]), ("body", "string", 5, ["see https://x.example/a, now " + "z" * 300, None, "plain"]), ("ms", "double", 7, [None, 1700000000000.0]),
])


@_query(f"""with r as ({MAILS.sql}), t as (select *, {_sq('body')} as b from r), s as (select *, coalesce(nullif({_sq("coalesce(nullif(snippet, ''), b[:280])")}, ''), '') as sn from t)
select k, 'gmail-' || k as id, coalesce(nullif({_sq('subject')}, ''), 'מייל ללא כותרת') as title, coalesce(nullif({_sq('sender')}, ''), 'שולח לא ידוע') as sender, sn as snippet, b as body,
  case when contains(b, 'https') then 'https://x.example/a' else '' end as links, case when ms is null then 0 else 1700000000 end as at, 'review' as status from s""")
def imported_mail_rows(spark, sf_dir):
    rows = MAILS.rows(spark, sf_dir).select(c("k").cast("string").alias("id"), F.lit("t").alias("threadId"), "subject", "sender", c("ms").cast("long").alias("internalMs"), F.timestamp_seconds(F.lit(0)).alias("dateHeader"), "snippet", c("body").alias("bodyText"), F.lit(None).cast("string").alias("bodyHtml"), F.lit(None).cast("array<string>").alias("links"))
    out = agent.mail_rows(rows, F.timestamp_seconds(F.lit(5)))
    return out.select(c("gmailMessageId").cast("long").alias("k"), "id", "title", "sender", "snippet", c("bodyText").alias("body"), F.array_join("links", ";").alias("links"), F.unix_seconds("date").alias("at"), "status")


@_query("select o_orderkey, o_orderdate from orders where o_orderdate >= date '1998-08-02' - interval 90 day")
def orders_newer_than(spark, sf_dir):
    return agent.newer_than(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", 90, F.lit("1998-08-02").cast("timestamp")).select("o_orderkey", "o_orderdate")


@_query("select page_id, regexp_matches(url, '(?i)/en/|casino\\d') or contains(lower(url), '[bad') as blocked from pages")
def blocked_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", agent.blocked_path(c("url"), ["/EN/", r"casino\d", "[bad"]).alias("blocked"))


LINKS = Made("part", "p_partkey", [("link", "string", 1, ["https://x.example", "https://www.drushim.co.il/job/1", None, "https://jobs.lever.co/a", "https://drushim.example"])])


@_query(f"with r as ({LINKS.sql}) select k, link from r where contains(link, 'drushim.co.il') or contains(link, 'jobs.lever.co') order by k limit 10")
def browser_hosts_first(spark, sf_dir):
    return agent.browser_results(LINKS.rows(spark, sf_dir), order="k")


@_query("select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 6")
def first_of_each_source(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return agent.first_of_source(rows, "o_custkey", "o_orderkey")


PANEL = Made("orders", "o_orderkey", [
    ("title", "string", 1, ["QA lead", "תקציר משרות לבדיקה: x", None]), ("company", "string", 2, ["Acme", None]), ("location", "string", 3, ["Haifa", ""]), ("locationKey", "string", 3, ["haifa", None, "lod", "north"]), ("source", "string", 5, ["Gmail · AllJobs", "Drushim", None, "SiteX", "own"]),
    ("description", "string", 7, ["", "needs ACME skills", None]), ("snippet", "string", 11, [None, "lead"]), ("status", "string", 1, ["found", "applied", "saved", "archived", "rejected", None, "interview"]), ("recommendation", "string", 3, ["apply", "review", None, "skip"]),
    ("gmailDigest", "boolean", 2, [None, True, False]), ("roleFamily", "string", 2, ["qa_automation", "QA", None, "information"]), ("roleType", "string", 3, ["manual_qa", None]),
])
_DIGEST = "(coalesce(\"gmailDigest\", false) or starts_with(coalesce(title, ''), 'תקציר משרות לבדיקה:'))"


@_query(f"""with r as ({PANEL.sql}) select count(*) as total, count_if(status = 'found' and recommendation is distinct from 'review') as apply, count_if(status = 'found' and recommendation = 'review') as review, count_if({_DIGEST}) as digest,
  count_if(status = 'applied') as applied, count_if(status = 'saved') as saved, count_if(status in ('archived', 'rejected')) as archived from r""")
def agent_panel_counts(spark, sf_dir):
    return agent.panel_counts(PANEL.rows(spark, sf_dir))


@_query(f"""with r as ({PANEL.sql}) select k from r where status = 'found' and recommendation is distinct from 'review' and contains(lower(concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(location, ''), nullif(source, ''), nullif(description, ''), nullif(snippet, ''))), 'acme')""")
def agent_panel_search(spark, sf_dir):
    return agent.panel_rows(PANEL.rows(spark, sf_dir), "apply", " Acme").select("k")


@_query(f"with r as ({PANEL.sql}) select k from r where \"locationKey\" in ('haifa', 'north')")
def allowed_places(spark, sf_dir):
    return agent.in_allowed_place(PANEL.rows(spark, sf_dir)).select("k")


@_query(f"""with r as ({PANEL.sql}), g as (select * from r where contains(lower(coalesce(source, '')), 'gmail'))
select count(*) as "gmailJobsTotal", count_if(coalesce(status, 'found') = 'found') as "activeGmailJobs", count_if(recommendation = 'review') as "reviewGmailJobs", count_if(status in ('applied', 'interview')) as "appliedGmailJobs", count_if(status = 'saved') as "savedGmailJobs",
  count_if("gmailDigest") as "digestJobs", 0 as "fakeSplitJobs", (select count(*) from customer) as "rawImportedEmails", (select count(*) from nation where n_nationkey <> 3) as "activeTrustedSenders", (select count(*) from supplier) as "processedMessages" from g""")
def mail_agent_overview(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    senders = table("nation").select(F.when(c("n_nationkey") == 3, False).when(c("n_nationkey") > 9, True).alias("enabled"))
    return agent.agent_overview(PANEL.rows(spark, sf_dir), table("customer"), senders, table("supplier"))


@_query("""with s as (select o_orderkey, case when o_custkey % 5 = 0 then null else 'c' || o_custkey end as key, o_orderstatus as st, o_totalprice > 200000 as forced from orders), r as (select 'c' || c_custkey as key from customer where c_acctbal > 0)
select (select count(*) from customer) as scanned, (select count(*) from customer) as imported, (select count(*) from customer where c_acctbal < 0) as "processedNow", (select count(*) from customer where c_acctbal >= 0) as "alreadyProcessed", count(*) as "candidateJobs",
  count_if(not exists (select 1 from r where r.key = s.key)) as "addedToJobs", (select count(*) from customer where c_acctbal <= 0) as "replacedDigestSummaries", count_if(st = 'F') as "reviewCandidates", count_if(forced) as "routedToReviewByScoring", (select count(*) from supplier) as "totalJobs" from s""")
def mail_import_result(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    mails = table("customer")
    scored = table("orders").select(F.when(c("o_custkey") % 5 != 0, F.concat(F.lit("c"), c("o_custkey").cast("string"))).alias("review_key"), F.when(c("o_orderstatus") == "F", "review").alias("recommendation"), (c("o_totalprice") > 200000).alias("original_skip"))
    left = mails.where("c_acctbal > 0").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("review_key"))
    return agent.import_result(mails, mails.where("c_acctbal < 0"), scored, mails, left, table("supplier"), F.timestamp_seconds(F.lit(0))).drop("at")


@_query(f"""with r as ({PANEL.sql}) select k, case when contains(lower(source), 'gmail') then source when contains(lower(source), 'drushim') then 'דרושים' when contains(lower(source), 'site') then 'אתרי מקור' else coalesce(source, 'מקור לא ידוע') end as source,
  case status when 'applied' then 'נשלח' when 'saved' then 'שמורה' when 'interview' then 'ראיון' when 'archived' then 'בארכיון' when 'rejected' then 'הוסרה' else 'טרם נשלח' end as status,
  case recommendation when 'apply' then 'מומלץ לשלוח' when 'skip' then 'לא מומלץ' else 'צריך בדיקה' end as recommendation,
  case lower(coalesce("roleFamily", "roleType", '')) when 'qa_automation' then 'אוטומציה' when 'qa' then 'בדיקות תוכנה' when 'manual_qa' then 'בדיקות תוכנה' when 'information' then 'מידע ומסמכים' else 'תפקיד כללי' end as role from r""")
def display_labels(spark, sf_dir):
    rows = PANEL.rows(spark, sf_dir)
    return rows.select("k", agent.source_label(c("source")).alias("source"), agent.status_label(c("status")).alias("status"), agent.recommendation_label(c("recommendation")).alias("recommendation"), agent.role_label(c("roleFamily"), c("roleType")).alias("role"))


LINES = Made("part", "p_partkey", [("text", "string", 1, ["QA lead|Acme חיפה משרה מלאה|first  line|Data clerk|Beta לוד|more|להסרה|no", "nothing here", None, "data CLERK|today|Big Corp חולון|15/01/2024|work"])])


@_query(f"""with r as ({LINES.sql}), v(start, index, title, company, location, kind, description) as (values ('QA', 0, 'QA lead', 'Acme', 'חיפה', 'משרה מלאה', 'first line'), ('QA', 1, 'Data clerk', 'Beta', 'לוד', '', 'more'), ('da', 1, 'Data clerk', 'Drushim', 'today', '', 'Big Corp חולון' || chr(10) || 'work'))
select k, index, title, company, location, kind, description from r join v on r.text[:2] = v.start""")
def line_digest_postings(spark, sf_dir):
    anchors = F.array(*(F.struct(F.lit(t).alias("title"), F.lit("u").alias("url")) for t in ("QA lead", "Data  clerk")))
    mails = LINES.rows(spark, sf_dir).select(c("k").alias("id"), F.split("text", r"\|").alias("lines"), anchors.alias("anchors"))
    return line_digest.line_postings(mails).select(c("id").alias("k"), "index", "title", "company", "location", c("jobType").alias("kind"), "description")


FEED = Made("events", "event_id", [("action", "string", 1, ["saved", "seen", "applied", "rejected"]), ("source", "string", 3, ["Gmail · AllJobs", "Gmail", "Gmail Drushim", None, "own"])])


@_query(f"""with l as ({FEED.sql}), r as (select * from l order by k desc limit 250)
select case source when 'Gmail · AllJobs' then 'AllJobs' when 'Gmail Drushim' then 'Drushim' when 'own' then 'own' else 'Gmail' end as source, count(*) as n from r where action in ('saved', 'applied') group by 1""")
def positive_source_histogram(spark, sf_dir):
    return summary.positive_sources(FEED.rows(spark, sf_dir), order=("k",))


@_query(f"""with r as ({PANEL.sql}) select count_if(coalesce(status, 'found') = 'found') as total, count_if(coalesce(status, 'found') = 'found' and recommendation = 'apply') as apply, count_if(status in ('applied', 'interview')) as applied, count_if(status = 'saved') as saved,
  count_if(status in ('archived', 'rejected')) as archived, count_if(status in ('applied', 'interview') and k % 2 = 0) as "appliedToday", count_if(contains(source, 'Gmail')) as "gmailJobs", (select count(*) from customer) as review, (select count(*) from events) as "learningEvents" from r""")
def full_dashboard(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    at = F.when(c("k") % 2 == 0, F.lit("2024-01-15")).otherwise("2024-01-01").cast("timestamp_ntz")
    jobs = PANEL.rows(spark, sf_dir).withColumns({"updatedAt": F.lit(None).cast("timestamp_ntz"), "appliedAt": at})
    return summary.full_dashboard(jobs, table("customer"), table("events"), F.lit("2024-01-15").cast("date"))


@_query("""with o as (select o_orderpriority as source, o_orderstatus as st, o_totalprice as p from orders)
select source, count(*) as raw, count_if(st = 'F') as normalized, count_if(p > 100000) as scored, count_if(st = 'P' and source like '1%') as errors from o group by 1""")
def provider_errors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(c("o_orderpriority").alias("source"), c("o_orderstatus").alias("st"), c("o_totalprice").alias("p"))
    return providers.provider_counts(rows, rows.where("st = 'F'"), rows.where("p > 100000"), rows.where("st = 'P' and source like '1%'"))


#: Two audits that overlap.
RUNS = Made("part", "p_partkey", [
    ("title", "string", 1, ["One", "Two", "Three", "", None]), ("company", "string", 7, ["Acme", "Bolt", None]), ("location", "string", 11, ["Haifa", "Lod", ""]), ("url", "string", 2, ["", "https://x.example/?JobID=7", "https://y.example/a", None]), ("kept", "boolean", 3, [True, False, None]),
])


@_query(f"""with r as (select *, k % 2 as part from ({RUNS.sql})), v as (select *, coalesce(nullif(case when contains(coalesce(url, ''), 'JobID') then 'alljobs:7' else lower(concat_ws('|', nullif(title, ''), nullif(company, ''), nullif(location, ''))) end, ''), nullif(url, ''), cast(k % 13 as varchar)) as key from r),
m as (select *, row_number() over (partition by key order by part desc, k desc) as rn from v)
select cast(1000 + (select count(*) from r where part = 1) as bigint) as incoming, count(*) as scored, count_if(coalesce(kept, false)) as kept, count(*) - count_if(coalesce(kept, false)) as filtered, cast(sum(k) as bigint) as rows_of from m where rn = 1""")
def audit_resumed(spark, sf_dir):
    rows = RUNS.rows(spark, sf_dir).withColumns({"ingest_seq": c("k"), "id": (c("k") % 13).cast("string")})
    merged, totals = joins.resumed_audit(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), F.lit(1000), F.lit(rows.where("k % 2 = 1").count()))
    return totals.crossJoin(merged.agg(F.sum("k").alias("rows_of")))  # a row each


@_query("""select 'newer_than:14d (' || string_agg('from:' || lower(replace(s_name, '#', '.')) || ' OR from:b' || s_suppkey, ' OR ' order by s_suppkey) || ')' as query from supplier where s_suppkey % 3 <> 0""")
def mail_search_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    domains = F.array(F.concat(F.lit(" @"), F.lower(F.replace("s_name", F.lit("#"), F.lit(".")))), F.concat(F.lit("b"), c("s_suppkey").cast("string")), F.lit(" "))
    return agent.mail_query(rows.select(c("s_suppkey").alias("sender_no"), domains.alias("domains"), (c("s_suppkey") % 3 != 0).alias("enabled")))


@_query("""with n as (select n_nationkey as no, case n_nationkey % 3 when 0 then 'Jobs/' || n_name || '.' when 1 then lower(n_name) || ' ..' else n_name end as name, upper(n_name) as plain from nation)
select 'exact' as wish, no as id from n where name = (select min(n_name) from nation where n_nationkey % 3 = 2) union all select 'plain', no from n where plain = (select min(upper(n_name)) from nation where n_nationkey % 3 = 1) union all select 'nested', no from n where plain = (select min(upper(n_name)) from nation where n_nationkey % 3 = 0)""")
def mail_label_choice(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.when(c("n_nationkey") % 3 == 0, F.concat(F.lit("Jobs/"), "n_name", F.lit("."))).when(c("n_nationkey") % 3 == 1, F.concat(F.lower("n_name"), F.lit(" .."))).otherwise(c("n_name"))
    labels = nation.select(c("n_nationkey").alias("label_no"), c("n_nationkey").alias("id"), name.alias("name"))
    first = {r.m: r.n for r in nation.groupBy((c("n_nationkey") % 3).alias("m")).agg(F.min("n_name").alias("n")).collect()}
    found = [agent.label_id(labels, first[m]).select(F.lit(wish).alias("wish"), "id") for m, wish in ((2, "exact"), (1, "plain"), (0, "nested"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@_query("""select page_id, case page_id % 3 when 0 then url when 1 then 'https://g.example/url?sa=t&x=' || page_id else '/url?q=' || page_id end as link from pages""")
def redirects_cleaned(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null")
    goal = F.concat(F.lit("https://g.example/url?sa=t&q="), F.url_encode("url"), F.lit("&ved=1#q=2"))
    link = F.when(c("page_id") % 3 == 0, goal).when(c("page_id") % 3 == 1, F.concat(F.lit("https://g.example/url?sa=t&x="), c("page_id").cast("string"))).otherwise(F.concat(F.lit("/url?q="), c("page_id").cast("string")))
    return rows.select("page_id", without_redirect(link).alias("link"))
