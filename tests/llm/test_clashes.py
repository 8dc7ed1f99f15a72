"""User columns with names that the operators use inside, and tables with awkward rows: values stay, rows stay."""

import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from larkspur.llm import cluster, dedup_exact, dedup_near, mixing, packing, quality_model, quality_rules, sharding, token_counts, url_filters  # noqa: E402

#: Names that appear inside of the operators.
INNER = """
b before bit bit_0 bit_1 bits block block_ branches bucket c c0 c1 cluster copies copy copy_no counts degree df dropped_id dropped_row fact_rows filter_bits filter_bits_0
filter_row filter_row_0 first fit fit_ g g_key g_length g_size group_ group_no h_ held hits host_ hub id image inside is_bad judged_row k key label label_id labelled
language last level level_ lists log_prob maybe members n name named node nth nth_ of_cluster of_group of_id of_key of_lang of_length of_row of_share own own_id part
pieces place plan_nth plan_place plan_share portion post posts prefix rank rank_no rejected_row rep reject row_no row_no_ rows rows_before s s_ seg set_key shape shape_
share_ share_weight shards sides size sketch spread stays sums tail text_bytes tl total trusted_id u units_ units_inside v value w whole_text x
""".split()
TEXT = "one two three four five six seven eight nine ten eleven twelve "


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rows = [(1, TEXT, "en", "src1"), (1, TEXT, "en", "src1"), (2, TEXT + "more", "de", "src2"), (3, None, None, None), (4, "", "en", "src1"), (None, "no id", "en", "x"), (5, TEXT * 40, "en", "src1"), (6, "q" * 20_000, "fr", "src3"), (7, " \t\n", "en", "src3"), (8, TEXT.upper(), "en", "src4")]
    docs = spark.createDataFrame([(*r, f"http://h{i}.com/a/{i}", 3 + i, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, url string, length long, no long")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("no")).alias(c) for c in INNER))
    path = str(tmp_path_factory.mktemp("awkward") / "docs")
    docs.repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def trusted(spark):
    return spark.createDataFrame([(1,), (2,), (None,), (1,)], "doc_id long")


CALLS = {
    "shard_rows": lambda s, d: sharding.shard_rows(d, 3),
    "pack": lambda s, d: packing.pack(d, 64, rows_per_group=2),
    "token_pieces": lambda s, d: packing.token_pieces(d, P.path("byte_bpe_50k.json"), 1 << 20),
    "count_tokens": lambda s, d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json")),
    "classify": lambda s, d: quality_model.classify(d, trusted(s)),
    "classify without trusted": lambda s, d: quality_model.classify(d, trusted(s).limit(0)),
    "mix_sources": lambda s, d: mixing.mix_sources(d, {"src1": 3, "src2": 1}, 2),
    "exact_dedup": lambda s, d: dedup_exact.exact_dedup(d),
    "filter_urls": lambda s, d: url_filters.filter_urls(d, url_filters.path_rules({"h1.com/": "block"}), id_col="doc_id"),
    "filter_urls with labels": lambda s, d: url_filters.filter_urls(d, [], s.createDataFrame([(1, True), (2, False)], "i long, bad boolean"), id_col="doc_id"),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d),
}
#: Those that return some of the rows, unchanged.
FILTERS = {
    "good_documents": lambda s, d: quality_model.good_documents(d, trusted(s)),
    "unique_documents": lambda s, d: dedup_exact.unique_documents(d),
    "near_dedup": lambda s, d: dedup_near.near_dedup(d),
}


def kept_values(df, columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", [*CALLS, *FILTERS])
def test_user_columns_keep_their_values(spark, awkward, name):
    docs = awkward
    inner = INNER
    if name == "shard_rows":  # its rows are grouped by all their columns
        inner = ["b", "before", "bucket", "c0", "c1", "copies", "copy", "first", "held", "image", "inside", "portion"]
        docs = docs.select("doc_id", "text", "no", *inner)
    if name == "pack":
        docs = docs.withColumn("length", F.col("length") % 60 + 1)
    if name in FILTERS:
        out = FILTERS[name](spark, docs)
        assert out.columns == docs.columns
        assert set(kept_values(out, docs.columns)) <= set(kept_values(docs, docs.columns)) and out.count() >= 1
    else:
        out = CALLS[name](spark, docs)
        columns = ["no", *(c for c in inner if c in out.columns)]
        replaced = {"classify": {"threshold"}}.get(name, set())
        assert set(inner) - set(columns) <= replaced
        assert kept_values(out, columns) == kept_values(docs, columns)
    empty = {**CALLS, **FILTERS}[name](spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_near_components_keep_one_row_each(spark, awkward):
    out = {(r["no"]): r for r in dedup_near.near_components(awkward, keep=["no"]).collect()}
    assert len(out) == awkward.count()
    assert [out[i]["component_id"] for i in (0, 1, 2, 9)] == [1, 1, 1, 1] and out[3]["component_id"] == 3 and out[5]["component_id"] is None


def test_rows_of_frequent_keys_meet_their_facts_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HEAVY", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaabbcz")], "key string, i int").withColumn("of_k", F.lit(7))
    facts = spark.createDataFrame([("a", "A", 5), ("b", "B", 2), ("c", "C", 1)], "k string, fact string, rows long")
    got = sorted((r["key"], r["i"], r["of_k"], r["fact"]) for r in cluster.met(rows, facts, [("key", "k")], ["fact"], "rows", 9, "left").collect())
    assert got == [(k, i, 7, k.upper() if k < "d" else None) for i, k in enumerate("aaaaabbcz")]
    assert cluster.met(rows, facts, [("key", "k")], ["fact"], "rows", 9).count() == 8


def test_mix_is_that_of_a_plain_earliest_deadline_first(spark):
    weights, others = {"a": 7, "b": 4, "c": 1}, 3
    docs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(200)], "doc_id long, source string")
    parts = [*weights.values(), others]
    total, done, order = sum(parts), [0] * 4, []
    for t in range(200):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(parts) if done[i] * total // w <= t]
        _, i = min(ready)
        order.append(("abc*"[i], done[i]))
        done[i] += 1
    place = {x: t for t, x in enumerate(order)}
    rows = mixing.mix_sources(docs, weights, others, rows_per_bucket=10).collect()
    hits = [(place[r["share"], r["block_no"]], r["position"]) for r in rows if (r["share"], r["block_no"]) in place]
    assert len(hits) > 90 and all(a == b for a, b in hits)


def test_shards_of_the_query(spark):
    import collections
    import zlib

    queries = pytest.importorskip("larkspur.llm.queries")
    out = queries.op1_sharding(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    slots = collections.defaultdict(list)
    assert len(out) == len(text)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["law"] == "rows"
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_rows_are_dropped_by_number(spark, monkeypatch):
    rows = spark.range(0, 5000, 1, 3).withColumn("row_no", F.monotonically_increasing_id()).withColumn("map_no", F.lit(1))
    dropped = rows.where("id % 7 = 0 or id between 1700 and 2100").select("row_no")
    want = sorted(i for i in range(5000) if i % 7 and not 1700 <= i <= 2100)
    for most in (cluster.BROADCAST_MAPS, 0):
        monkeypatch.setattr(cluster, "BROADCAST_MAPS", most)
        got = cluster.without(rows, "row_no", dropped)
        assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == want
        assert cluster.without(rows, "row_no", dropped.limit(0)).count() == 5000
