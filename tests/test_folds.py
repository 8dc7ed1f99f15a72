"""Ordered folds: arrays and sorted streams give the same rows, and a key with very many variants needs one row of state."""

import random

from pyspark.sql import functions as F

from larkspur.operators import dedupe
from larkspur.operators.merge import merge_variants, variant_step
from larkspur.plans.flows import _blocked, _real, blocked_location, real_location


def variants(spark, n, keys, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            i, f"id{i}" if r.random() < 0.8 else None, r.choice(["QA", "QA tester", "job in רעננה", None]), r.choice(["Acme", "חברה חסויה", "", None, "Bolt"]), r.choice(["Haifa", "Israel", "", None, "ירושלים", "Nesher"]), r.choice(["haifa", None, "unknown", "jerusalem", "tel_aviv"]),
            f"https://x.example/?JobID={r.randrange(keys)}", r.choice([None, "", "w " * r.randrange(200)]), r.choice([["a"], None, []]), None,
        ))
    return spark.createDataFrame(rows, "ingest_seq long, id string, title string, company string, location string, locationKey string, url string, description string, reasons array<string>, foundAt string")


def test_streams_and_arrays_give_the_same_rows(spark, monkeypatch):
    rows = variants(spark, 900, 12)
    plain = sorted(map(repr, merge_variants(rows, real_location, blocked_location).collect()))
    for many in (0, 60, 10**6):
        monkeypatch.setattr(dedupe, "MANY", many)
        got = merge_variants(rows, real_location, blocked_location, variant_step(_real, _blocked))
        assert sorted(map(repr, got.collect())) == plain


def test_rules_on_rows_as_dicts(spark):
    rows = variants(spark, 400, 5, seed=8)
    whole = F.struct(*rows.columns)
    for r in rows.select(whole.alias("r"), real_location(whole).alias("real"), blocked_location(whole).alias("blocked")).collect():
        assert (_real(r.r.asDict()), _blocked(r.r.asDict())) == (r.real, r.blocked)


def test_a_hot_key_is_a_stream(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 1000 == 1, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("ingest_seq"), (F.col("id") % 7).alias("v"), F.lit("x" * 200).alias("text"))
    folded = dedupe.fold_sorted(rows, "k", lambda a, b: a | {"v": (a["v"] * 31 + b["v"]) % 1_000_003})
    got = {r.position: r.v for r in folded.collect()}
    want = None
    for i in range(1_000_000):
        if i % 1000 != 1:
            want = i % 7 if want is None else (want * 31 + i % 7) % 1_000_003
    assert len(got) == 1001 and got[0] == want and got[1] == 1
    assert dedupe.fold_sorted(rows.limit(0), "k", lambda a, b: a).count() == 0
