"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from larkspur.llm import dedup_exact, dedup_near, mixing, packing, quality_model, quality_rules, sharding, token_counts, token_files, url_filters  # noqa: E402
from larkspur.llm.cluster import shared_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, kept string, shard string"
LONG = "many words of a long text " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], f"changed{k}", *words[k + 1 :]]) for k in (5, 30, 55)]
    rows = [(i, t) for i, t in enumerate(["same text here", "same  text\there", "same text here", None, "", " ", LONG, "short", *near, " ".join(words), "é漢字 <|endoftext|> it's"])]
    rows += [(100, "repeated row"), (100, "repeated row"), (None, "no id"), (None, "no id"), (7, "short")]
    return spark.createDataFrame([(i, t, "en", "a", "x", "y", "z") for i, t in rows], SCHEMA)


def test_sharding(spark, docs):
    out = sharding.shard_rows(docs, 4, seed=1, rows_per_bucket=3, copies_per_task=1)
    rows = out.collect()
    assert len(rows) == docs.count() and sorted(r["row_no"] for r in rows) == list(range(len(rows)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = lambda d: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in sharding.shard_rows(d, 4, seed=1, rows_per_bucket=3).collect())
    assert place(docs) == place(docs.repartition(3))
    assert place(docs) != sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in sharding.shard_rows(docs, 4, seed=2, rows_per_bucket=3).collect())
    assert sharding.shard_rows(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 101, 997])
def test_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 9).alias("y")).collect()
    assert sorted(r["y"] for r in got) == list(range(n))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    pieces = packing.token_pieces(docs, P.path("byte_bpe_50k.json"), 64, 2, keep=["doc_id", "kept"])
    rows = packing.pack(pieces, 64, rows_per_group=2).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, b"".join(i.to_bytes(4, "little") for i in ids[a:b])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) == -(-sum(r["length"] for r in rows) // 64)
    assert packing.pack(pieces.limit(0), 64).count() == 0


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), limit=100, keep_text=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_exact_dedup(spark, docs, monkeypatch):
    import re

    rows = dedup_exact.exact_dedup(docs).collect()
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    assert len(rows) == docs.count() and sum(r["kept"] for r in rows) == len(groups)
    for r in rows:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["text_sha256"] == norm(r["text"]) and r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert dedup_exact.exact_dedup(docs.limit(0)).count() == 0
    again = dedup_exact.exact_dedup(docs, bits_per_row=1).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    monkeypatch.setattr(dedup_exact, "BROADCAST_ROWS", 1)  # a filter of many slices
    monkeypatch.setattr(dedup_exact, "ROW_BITS", 8)
    for bits in (1, 16):
        assert docs.count() * bits > 8
        again = dedup_exact.exact_dedup(docs, bits_per_row=bits).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, rows))
    keyed = docs.select("doc_id", dedup_exact.text_sha256(docs["text"]).alias("key"))
    flagged = dedup_exact.maybe_repeated(keyed, "key", docs.count(), 1, "maybe")
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" in plan, "no row moves, whatever the size of the filter"


def test_near_dedup(spark, docs):
    got = collections.defaultdict(set)
    rows = dedup_near.near_components(docs).collect()
    for r in rows:
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert len(rows) == docs.count()
    assert all(got[i] == {(8, i == 8)} for i in (8, 9, 10, 11)), "near copies meet in the unchanged text"
    assert got[0] == {(0, True)} and got[1] == {(0, False)} and got[3] == {(3, True)} and got[4] == {(4, True)} and got[5] == {(5, True)}
    assert got[None] == {(None, True)} and got[100] == {(100, True)}
    assert dedup_near.near_components(docs.limit(0)).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    """A chain of near copies, blocks of a few rows: links between blocks aren't lost."""
    words = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(30):  # each text differs from the next in one more place
        texts.append(" ".join([*(f"v{i}" for i in range(k)), *words[k:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dedup_near, "BLOCK_CLASSES", 4)
    assert {r["component_id"] for r in dedup_near.near_components(docs).collect()} == {0}


def test_mixing(spark):
    rows = [(i, s) for i, s in enumerate("a" * 50 + "b" * 30 + "c" * 7)] + [(None, None), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("position", F.lit("clash"))
    weights = {"a": 5, "b": 3, "c": 2}
    out = mixing.mix_sources(docs, weights, rows_per_bucket=7).collect()
    assert len(out) == len(rows) and all(r["position"] is None for r in out if r["source"] is None)
    mix = sorted((r["position"], r["source"]) for r in out if r["in_mix"])
    assert [p for p, _ in mix] == list(range(len(mix))) and len(mix) >= 30
    seen = collections.Counter()
    for t, (_, s) in enumerate(mix, 1):
        seen[s] += 1
        assert all(abs(seen[k] - t * w / 10) < 1 for k, w in weights.items())
    assert all(r["release"] <= r["position"] < r["deadline"] for r in out if r["position"] is not None)
    assert mixing.mix_sources(docs, {"none": 1}).where("in_mix").count() == 0
    assert mixing.mix_sources(docs, {"a": 1}, others=1, slack=0.5).where("position is not null").count() == len(rows)
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = shared_dir(spark)
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    token_files.write_token_files(known, P.path("word_bpe_49k.json"), path, tokens_per_file=3000)
    text = {r["doc_id"]: r["text"] for r in known.collect()}
    start = 0
    rows = token_files.read_token_files(spark, path).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(text)
    for r in rows:
        ids = [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids)) and zlib.crc32(bytes(r["ids"])) == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    empty = shared_dir(spark)
    token_files.write_token_files(docs.limit(0), P.path("word_bpe_49k.json"), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_quality_rules(spark, docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[6]["base_failed"] and not got[6]["kept"] and got[11]["kept"] and got[3]["n_words"] == 0 and not got[3]["kept"]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_url_filters(spark):
    rules = url_filters.path_rules({"net/": "block", "example.net/en/": "allow", "org/fr/": "allow"})
    urls = [None, "no scheme", "HTTP://A.NET/x?y", "http://www.example.net/en/1", "http://example.net", "http://b.org/fr/", "http://b.org/fr", "http://spam.com/buy/1", *(f"http://spam.com/buy/{i}" for i in range(2, 12)), *(f"http://ok.com/{w}/{i}" for i in range(5) for w in "abc")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, rules).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(7)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("b.org", "/fr", None, "allow"),
    ]
    labels = spark.createDataFrame([(i, True) for i in range(8, 16)] + [(i, False) for i in range(20, 30)], "id long, bad boolean")
    judged = url_filters.filter_urls(pages, rules, labels).collect()
    assert len(judged) == len(urls)
    assert {r["verdict"] for r in judged if r["host"] == "spam.com"} == {"block"} and {r["verdict"] for r in judged if r["host"] == "ok.com"} == {"allow"}
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    import random

    r = random.Random(4)
    rows = [(i, " ".join(f"word{r.randrange(200)}" for _ in range(60)), "en", f"src{i % 20}", 10) for i in range(120)]
    rows += [(500, rows[3][1], "en", "src3", 10), (501, rows[4][1] + " more", "en", "src4", 10), (502, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "exact_dedup":
            assert out.where("doc_id = 500").count() == 0 and out.where("doc_id = 3").count() == 1
        if name == "near_dedup":
            assert out.where("doc_id = 501").count() == 0 and out.where("doc_id = 4").count() == 1
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_mix_keeps_every_document(spark):
    """Three sources of one document each and a hot one: the mix orders, it doesn't end."""
    import corpus_pipeline

    rows = [(i, "some words", "en", f"src{i}" if i < 3 else "src3" if i < 103 else f"src{3 + i % 17}" if i < 300 else None, 10) for i in range(310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect()]
    assert sorted(out) == sorted(rows)
    assert len({r[3] for r in out[:40]}) == 21  # the first deadline of the smallest share
    place = {r["doc_id"]: r["position"] for r in corpus_pipeline.packing(spark, docs.repartition(3), "").collect()}
    assert [r[0] for r in out] == sorted(place, key=place.get)


def test_quality_levels_of_small_languages(spark):
    """Four held-out documents of a language (null is one) count, and one more document doesn't switch the rule."""
    import random

    r = random.Random(1)
    big = [("en", 1.5 + r.gauss(0, 1) / 30, 900) for _ in range(400)] + [("fr", 1.4 + r.gauss(0, 1) / 30, 900) for _ in range(100)]

    def levels(small):
        sample = spark.createDataFrame([*big, *small], "lang string, bits double, text_bytes long")
        rows, others = quality_model.levels_by_language(sample, 0.99, 3.0)
        return {x["lang"]: x for x in rows.collect()}, others

    got, others = levels([("de", 2.0 + d, 900) for d in (0.02, -0.02, 0.01, -0.01)] + [(None, 3.0, 900)])
    assert abs(got["de"]["level"] - 2) < 0.05 and abs(got[None]["level"] - 3) < 0.1 and abs(got["en"]["level"] - 1.5) < 0.01
    assert got[None]["spread"] > got["de"]["spread"] > got["en"]["spread"] and others[1] > got[None]["spread"]
    small = [("de", 2.0 + r.gauss(0, 1) / 30, 900) for _ in range(30)]
    (a, _), (b, _) = levels(small[:29]), levels(small)
    assert abs(a["de"]["level"] - b["de"]["level"]) < 0.02 and abs(a["de"]["threshold"] - b["de"]["threshold"]) < 1


def test_quality_threshold_is_the_quantile(spark):
    """What lies well above the quantile of held-out noise is beyond the threshold: no factor and no floor."""
    from statistics import NormalDist

    noise = [NormalDist().inv_cdf((i + 0.5) / 2000) for i in range(2000)]
    sample = spark.createDataFrame([("en", 1.5 + x / 30, 900) for x in noise], "lang string, bits double, text_bytes long")
    rows, others = quality_model.levels_by_language(sample, 0.99, 3.0)
    assert all(2.33 <= t < 2.7 for t in (rows.first()["threshold"], others[2]))
