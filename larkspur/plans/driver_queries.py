"""Queries of the operators over the driver's tables, with the SQL that gives the same rows.

Roles of the tables: documents are postings (source, lang as place, text as description), labels are
decisions, events are the feedback log (user_id as posting, event_type as action), pages are crawled HTML,
conversations are mails; the other tables serve the relational operators at volume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import FirstMatch
from ..functions.text import base64url, normalized, slug_id, squeezed, tail, tokens
from ..functions.urls import host, links_in_html, strip_html
from ..operators import dedupe, joins, merge, search, summary
from ..sources.tables import written

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


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an audit: kept if labelled good, apply or review by length."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    word = F.when(c("n_chars") >= 3000, "apply").when(c("n_chars") >= 1000, "review").otherwise("skip")
    return docs.select("doc_id", "source", "lang", "n_chars", "text").join(labels, "doc_id", "left").withColumns({"kept": F.coalesce(c("quality") == 1, F.lit(False)), "recommendation": word})


@_query("""
select d.source, count(*) as total, count(*) filter (where l.quality = 1) as kept, count(*) filter (where coalesce(l.quality, 0) <> 1) as filtered,
  count(*) filter (where d.n_chars >= 3000) as apply, count(*) filter (where d.n_chars >= 1000 and d.n_chars < 3000) as review
from documents d left join labels l using (doc_id) group by d.source order by kept desc, total desc, source
""")
def scan_summary_by_source(spark, sf_dir):
    return summary.scan_summary(_audit(spark, sf_dir))


@_query("select coalesce(nullif(event_type, ''), 'unknown') as key, count(*) as n from events group by 1")
def count_by_event_type(spark, sf_dir):
    return summary.count_by(_t(spark, sf_dir, "events"), c("event_type"))


@_query(r"""
with k as (select doc_id, n_chars, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) as t from documents),
r as (select *, row_number() over (partition by t order by n_chars desc, doc_id) as rn, min(doc_id) over (partition by t) as position from k)
select doc_id, n_chars, position from r where rn = 1 and t <> ''
""")
def dedupe_best_by_fingerprint(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    # the key of a whole text is its hash: what is shuffled stays small
    # and is written first, since filters on it would be moved below it and work it out again
    rows = written(docs.select("doc_id", "n_chars", F.nullif(F.sha2(normalized(c("text")), 256), F.sha2(F.lit(""), 256)).alias("key_")))
    return dedupe.best_by_key(rows, c("key_"), c("n_chars"), "doc_id").select("doc_id", "n_chars", "position")


@_query("""
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) rn from events) where rn = 1
""")
def dedupe_first_wins(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return dedupe.first_by_key(events, F.concat_ws("|", "user_id", "event_type"), "event_id").select("user_id", "event_type", "event_id", "value")


@_query("""
select user_id, event_id, value, position from (select *, row_number() over (partition by user_id order by event_id desc) rn, min(event_id) over (partition by user_id) as position from events) where rn = 1
""")
def audit_merge_last_wins(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return dedupe.last_by_key(events, c("user_id"), "event_id").select("user_id", "event_id", "value", "position")


@_query("""
with r as (select o_custkey, o_orderkey, case o_orderstatus when 'F' then 300 when 'O' then 200 else 0 end + case when o_orderpriority like '1%' then 25 else 0 end + floor(o_totalprice / 1000) as points from orders)
select o_custkey, o_orderkey, cast(points as bigint) as points from (select *, row_number() over (partition by o_custkey order by points desc, o_orderkey) rn from r) where rn = 1
""")
def unique_store_rank(spark, sf_dir):
    word = F.when(c("o_orderstatus") == "F", "apply").when(c("o_orderstatus") == "O", "review")
    place = F.when(F.startswith(c("o_orderpriority"), F.lit("1")), "known")
    points = dedupe.store_rank(word, place, F.floor(c("o_totalprice") / 1000))
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", points.cast("long").alias("points"))
    return dedupe.best_by_key(rows, c("o_custkey"), c("points"), "o_orderkey").select("o_custkey", "o_orderkey", "points")


def _per_customer(orders: DataFrame) -> DataFrame:
    rows = orders.select(c("o_custkey").cast("string").alias("job_key"), c("o_orderkey").cast("string").alias("id"), c("o_orderpriority").alias("title"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("status"), "o_orderkey")
    return dedupe.first_by_key(rows, c("job_key"), "o_orderkey").select("job_key", "id", "title", "status", F.lit(1).alias("seenCount"))


@_query("""
with f as (select *, row_number() over (partition by o_custkey, o_orderdate < timestamp '1995-09-01' order by o_orderkey) rn from orders),
e as (select * from f where rn = 1 and o_orderdate < timestamp '1995-09-01'), i as (select * from f where rn = 1 and o_orderdate >= timestamp '1995-09-01')
select cast(coalesce(e.o_custkey, i.o_custkey) as varchar) as job_key, cast(coalesce(e.o_orderkey, i.o_orderkey) as varchar) as id, case when i.o_custkey is not null then i.o_orderpriority else e.o_orderpriority end as title,
  coalesce(nullif(e.o_orderstatus, 'P'), nullif(i.o_orderstatus, 'P')) as status, case when e.o_custkey is null then 2 when i.o_custkey is null then 1 else 2 end as "seenCount"
from e full join i on e.o_custkey = i.o_custkey
""")
def upsert_full_outer(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    old = _per_customer(orders.where(c("o_orderdate") < F.lit("1995-09-01").cast("timestamp_ntz")))
    new = _per_customer(orders.where(c("o_orderdate") >= F.lit("1995-09-01").cast("timestamp_ntz")))
    return merge.upsert(old, new, F.lit(None).cast("timestamp"))


@_query("select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
def updated_semi(spark, sf_dir):
    snapshot = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return joins.updated_rows(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), snapshot, "c_custkey")


@_query("""
select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) or exists (select 1 from benchmark b where b.item_id = d.doc_id) as kept from documents d
""")
def audit_kept_mark_or(spark, sf_dir):
    good = _t(spark, sf_dir, "labels").where("quality = 1")
    rows = _t(spark, sf_dir, "documents").select("doc_id")
    return joins.marked(rows, [(c("doc_id"), good, "doc_id"), (c("doc_id"), _t(spark, sf_dir, "benchmark"), "item_id")], "kept").select("doc_id", "kept")


@_query("""
select cast(n_nationkey as varchar) || ':' || p.provider as step_id, cast(n_nationkey * 5 + p.i as bigint) as step, n_nationkey as query_index, n_name as query, p.provider
from nation cross join (values (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY')) p(i, provider)
""")
def scan_steps_cross(spark, sf_dir):
    queries = _t(spark, sf_dir, "nation").select(c("n_nationkey").alias("query_index"), c("n_name").alias("query"))
    return joins.scan_steps(queries, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


PLACES = [("metal", ["steel", "brass", "copper"]), ("light", ["tin", "nickel"]), ("small", ["small"]), ("promo", ["promo", "economy"])]


@_query("""
select p_partkey, case when regexp_matches(p_type, '(?i)steel|brass|copper') then 'metal' when regexp_matches(p_type, '(?i)tin|nickel') then 'light' when regexp_matches(p_type, '(?i)small') then 'small' when regexp_matches(p_type, '(?i)promo|economy') then 'promo' end as place from part
""")
def rule_first_match_location(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", FirstMatch(PLACES).value(c("p_type")).alias("place"))


@_query(r"""
with t as (select item_id, list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), '[^a-z0-9א-ת+#. \t\n\r\f\v-]', ' ', 'g')), '[ \t\n\r\f\v]+'), lambda x: len(x) >= 3 and x not in ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'role', 'job', 'jobs'))[1:160]) as w from benchmark)
select a.item_id, cast(len(list_intersect(a.w, b.w)) as integer) as overlap from t a cross join (select w from t where item_id = (select min(item_id) from benchmark)) b
""")
def tokenize_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "benchmark").select("item_id", tokens(F.trim(c("text"))).alias("w"))
    first = rows.agg(F.min_by("w", "item_id").alias("base"))  # one row
    return rows.crossJoin(F.broadcast(first)).select("item_id", F.size(F.array_intersect("w", "base")).alias("overlap"))


@_query("""
select page_id, cast((contains(html, '<script')::int + contains(html, 'cookie')::int + contains(html, '<nav')::int + contains(html, 'footer')::int + contains(html, 'utm_')::int) >= 2 as boolean) or length(html) > 12000 as noise from pages
""")
def page_noise_guard(spark, sf_dir):
    from ..functions.rules import count_hits

    n = count_hits(c("html"), ["<script", "cookie", "<nav", "footer", "utm_"])
    return _t(spark, sf_dir, "pages").select("page_id", ((n >= 2) | (F.length("html") > 12_000)).alias("noise"))


@_query(r"""
select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '[ \t\n\r\f\v\x{00A0}\x{FEFF}]+', ' ', 'g'))) as text_md5 from pages
""")
def html_strip(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(strip_html(c("html"))).alias("text_md5"))


@_query(r"""
select page_id, len(l) as n_links, array_to_string(list_transform(l, lambda x: replace(x, '&amp;', '&')), ' ') as links from (select page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) as l from pages)
""")
def html_links(spark, sf_dir):
    found = links_in_html(c("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


@_query(r"""select page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') as host from pages""")
def url_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", host(c("url")).alias("host"))


@_query(r"""select c_custkey, substr(trim(regexp_replace(lower(c_name || '|' || c_mktsegment), '[^a-z0-9א-ת]+', '-', 'g'), '-'), 1, 160) as id from customer""")
def job_id_slug(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", slug_id(c("c_name"), c("c_mktsegment")).alias("id"))


@_query("select doc_id, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') as id from documents")
def review_id_base64url(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", base64url(c("text")).alias("id"))


@_query("select doc_id, n_chars from documents where contains(lower(source || ' ' || text), 'license') and lang = 'en' and n_chars >= 100 order by n_chars desc, doc_id")
def faceted_search(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", c("text").alias("description"), c("lang").alias("location"))
    found = search.search(docs, search.Facets(term="license", location="en"))
    return found.where("n_chars >= 100").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@_query("select distinct source from documents where source <> '' order by 1")
def facet_values(spark, sf_dir):
    return summary.facet(_t(spark, sf_dir, "documents"), "source")


@_query("""
select event_id, event_type from events where not ((event_type = 'error' and ts < timestamp '2024-01-31' - interval 7 day) or (event_type = 'purchase' and ts < timestamp '2024-01-31' - interval 20 day))
""")
def retention_cleanup(spark, sf_dir):
    status = F.when(c("event_type") == "error", "archived").when(c("event_type") == "purchase", "applied").otherwise("found")
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", status.alias("status"), c("ts").alias("createdAt"))
    return search.retained(rows, F.lit("2024-01-31").cast("timestamp_ntz"), 7, 20).select("event_id", "event_type")


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_k_new(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@_query("select p_partkey, case when p_size * 2 >= 85 then 'excellent' when p_size * 2 >= 70 then 'good' when p_size * 2 >= 55 then 'medium' else 'low' end as band from part")
def score_bands(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", search.score_band(c("p_size") * 2).alias("band"))


@_query("""
select user_id, event_id, coalesce(next_event, -1) as next_event from (select user_id, event_id, lead(event_id) over (partition by user_id order by ts, event_id) as next_event from events)
""")
def next_row_boundary(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("next_event"))


@_query(r"""
select doc_id, array_to_string(list_slice(ws, greatest(len(ws) - 4, 1), len(ws)), ' ') as last_words from (select doc_id, string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' ') as ws from documents)
""")
def tail_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(tail(F.split(squeezed(c("text")), " "), 5), " ").alias("last_words"))


@_query("""
select key, max_by(value, event_id) as value, min(event_id) as position from (select user_id as key, value, event_id from events where event_type <> '') group by key
""")
def stored_union_latest(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(c("user_id").alias("key"), "value", "event_id", "event_type")
    both = events.where("event_type = 'click'").unionByName(events.where("event_type <> 'click'")).drop("event_type")
    return dedupe.last_by_key(both, c("key"), "event_id").select("key", "value", "position")


@_query()
def scan_flow(spark, sf_dir):
    """The whole scan over documents as landed provider rows; no SQL has the rule set."""
    from .flows import Wishes, scan

    docs = _t(spark, sf_dir, "documents")
    landed = docs.select(c("source").alias("sourceQuery"), c("text").alias("title"), c("source").alias("company"), c("lang").alias("location"), F.concat(F.lit("https://x.example/?JobID="), c("doc_id")).alias("link"), c("text").alias("description"))
    from ..schemas import FEEDBACK, JOBS

    stored = spark.createDataFrame([], JOBS).drop("ingest_seq")
    out = scan({"alljobs": landed.where("lang = 'en'"), "drushim": landed.where("lang <> 'en'")}, stored, spark.createDataFrame([], FEEDBACK), Wishes(), F.lit("2024-01-01").cast("timestamp"))
    return out.audit.groupBy("source", "decision", "recommendation").agg(F.count(F.lit(1)).alias("n"), F.avg("fitScore").alias("mean_score"))
