"""The n-gram model against an independent Kneser-Ney in plain Python, with many shards and tiny blocks."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality_model

ORDER = quality_model.ORDER


class PlainKneserNey:
    def __init__(self, texts, order):
        self.order = order
        counts = collections.Counter()
        for t in texts:
            data = b"\0" * (order - 1) + (t or "").encode()
            counts.update(data[i : i + order] for i in range(len(data) - order + 1))
        self.levels = {order: counts}
        for n in range(order - 1, 0, -1):
            self.levels[n] = collections.Counter(g[1:] for g in self.levels[n + 1])
        self.cuts, self.total, self.left = {}, {}, {}
        for n, level in self.levels.items():
            n1, n2, n3, n4 = (max(1, sum(c == i for c in level.values())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            self.cuts[n] = [min(max(d, 0.01), i - 0.01) for i, d in zip((1, 2, 3), raw)]
            total, cut = collections.Counter(), collections.Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                cut[g[:-1]] += self.cuts[n][min(c, 3) - 1]
            self.total[n], self.left[n] = total, cut

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        lower, context = self.p(gram[1:]), gram[:-1]
        total = self.total[n][context]
        if not total:
            return lower
        c = self.levels[n][gram]
        own = (c - self.cuts[n][min(c, 3) - 1]) / total if c else 0
        return own + self.left[n][context] / total * lower

    def log_prob(self, text):
        data = b"\0" * (self.order - 1) + text.encode()
        return sum(math.log(self.p(data[i : i + self.order])) for i in range(len(data) - self.order + 1))


def some_texts(n, seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "house", "water", "gärten", "letter", "漢字", "x", "running", "Zug"]
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model_docs(spark, tmp_path_factory):
    texts = some_texts(150, 1) + ["!! odd %% text 0815 never seen before" * 4, None, "", "a", "q" * 5000]
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)] + [(0, texts[0], "de"), (None, texts[1], None)]
    path = str(tmp_path_factory.mktemp("model") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("settings", [{}, {"SHARD_ENTRIES": 40, "BLOCK_BYTES": 700, "TASK_BYTES": 90, "CHUNK_ENTRIES": 7}])
def test_log_probabilities_are_those_of_plain_kneser_ney(spark, model_docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(quality_model, name, value)
    trusted = [r["text"] for r in model_docs.where("doc_id < 100").collect()]
    plain = PlainKneserNey(trusted, ORDER)
    model = quality_model.kneser_ney(quality_model.gram_counts(model_docs.where("doc_id < 100"), "text"))
    shards = max(quality_model.LEAST_SHARDS, -(-model.count() // quality_model.SHARD_ENTRIES))
    assert shards >= (8 if settings else 16)
    docs = model_docs.withColumn("no", F.monotonically_increasing_id())
    got = {r["row_no"]: r for r in quality_model.scores(docs, model, "no").collect()}
    seen = 0
    for r in docs.collect():
        if not r["text"]:
            assert r["no"] not in got
            continue
        seen += 1
        assert got[r["no"]]["text_bytes"] == len(r["text"].encode())
        assert math.isclose(got[r["no"]]["log_prob"], plain.log_prob(r["text"]), rel_tol=1e-5)
    assert seen == len(got)


def test_perplexity_of_classify_and_of_the_stage(spark, model_docs, monkeypatch, tmp_path):
    monkeypatch.setattr(quality_model, "SHARD_ENTRIES", 100)
    monkeypatch.setattr(quality_model, "BLOCK_BYTES", 1500)
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    trusted = spark.range(100)
    out = quality_model.classify(model_docs, trusted)
    rows = out.collect()
    assert len(rows) == model_docs.count()
    held = {r["id"] for r in trusted.where(F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(1000)) < 200).collect()}
    plain = PlainKneserNey([r["text"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 100 and r["doc_id"] not in held], ORDER)
    for r in rows:
        if r["text"]:
            assert math.isclose(r["perplexity"], math.exp(-plain.log_prob(r["text"]) / len(r["text"].encode())), rel_tol=1e-5)
            assert r["kept"] == (r["excess"] <= r["threshold"])
        else:
            assert r["perplexity"] is None and not r["kept"]
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality_classifier(spark, model_docs, str(tmp_path))
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["lang"]))
    assert kept.columns == model_docs.columns and sorted(map(key, kept.collect())) == sorted(key(r) for r in rows if r["kept"])
    monkeypatch.setattr(quality_model.cluster, "BROADCAST_IDS", 0)
    assert sorted(map(key, corpus_pipeline.quality_classifier(spark, model_docs, str(tmp_path)).collect())) == sorted(key(r) for r in rows if r["kept"])


def test_classify(spark):
    r = random.Random(0)
    say = lambda: " ".join(r.choice(["the", "of", "and", "house", "water", "garden", "letter"]) for _ in range(80))
    rows = [(i, say(), "en") for i in range(300)] + [(1000, "#%$ @@ ZZQX 9981 ~~" * 30, "en"), (1001, None, "en"), (1002, "", None), (1003, say(), None), (1003, say(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("threshold", F.lit(1))
    trusted = spark.range(200).union(spark.createDataFrame([(None,)], "id long"))
    out = quality_model.classify(docs, trusted)
    got = {x["doc_id"]: x for x in out.collect()}
    assert out.count() == len(rows) and all(got[i]["kept"] for i in [*range(300), 1003])
    assert not got[1000]["kept"] and not got[1001]["kept"] and got[1002]["perplexity"] is None
    assert quality_model.classify(docs, spark.range(0)).where("kept").count() == len(rows)
    assert quality_model.classify(docs.limit(0), trusted).count() == 0


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abracadabra",), ("abba",), (None,)], "text string")
    model = quality_model.kneser_ney(quality_model.gram_counts(docs, "text", 3), 3)
    rows = model.toPandas()
    shard = quality_model.Shard(3, [(k, n, g.gram.to_numpy().astype(np.uint64), g.weight.to_numpy()) for (k, n), g in rows.groupby(["kind", "n"])])
    for context in (b"\0\0", b"ab", b"zz", b"ra"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp(shard.log_probability(grams)).sum() - 1) < 1e-4
