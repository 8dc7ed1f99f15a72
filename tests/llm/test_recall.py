"""Near-dedup from end to end against brute force on true word tuples, at sf0.01."""

import collections
import re

import pytest

queries = pytest.importorskip("larkspur.llm.queries")


def plain_components(texts):
    sets, lists = {}, collections.defaultdict(list)
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            lists[x].append(i)
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = 0
    for i, own in sets.items():
        shared = collections.Counter(j for x in own for j in lists[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                links += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in texts}, sets, links


def test_no_link_is_lost_or_added(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want, sets, links = plain_components(texts)
    rows = queries.op9_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and links > 50
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
