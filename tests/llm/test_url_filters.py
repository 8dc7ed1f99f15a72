"""The template tree, its merges and purities against plain Python, and both verdicts on pages without a rule."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import url_filters

S = url_filters.TreeSettings(most_children=4, rare_share=0.2, depth=3)


def plain(urls, bad_of, s):
    """(template, bad_share) of each url."""
    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def shape(path):
        out = ["{long}" if len(x) > 80 else x for x in (re.sub(r"[0-9]+", "{n}", x) for x in path.split("/") if x)]
        return tuple(out[: s.depth] + (["{**}"] if len(out) > s.depth else []))

    where = [(h, shape(p)) for h, p in map(parts, urls)]
    children = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0, collections.Counter()]))
    for (host, segs), bad in zip(where, bad_of):
        for k, seg in enumerate(segs):
            c = children[host, segs[:k]][seg]
            c[0] += 1
            c[1] += bad is not None
            c[2] += bad or 0
            c[3][re.sub(r"[^/{}]+(?![^/{}]*\})", "w", "/".join(segs[k + 1 :]))] += 1
    names = {}
    for node, group in children.items():
        main = {seg: max((n, k) for k, n in c[3].items())[1] for seg, c in group.items()}
        for seg, (n, labelled, bad, kinds) in group.items():
            alike = [x for x in group if main[x] == main[seg]]
            pool = collections.Counter()
            for x in alike:
                pool.update(group[x][3])
            total = sum(pool.values())
            chi = sum((kinds[k] - n * pool[k] / total) ** 2 / (n * pool[k] / total) for k in pool)
            free = len(pool) - 1
            p = (sum(group[x][2] for x in alike) + 0.5) / (sum(group[x][1] for x in alike) + 1)
            same = not labelled or abs(bad / labelled - p) <= s.merge_z * math.sqrt(p * (1 - p) / labelled)
            name = seg
            if len(alike) > 1 and main[seg] and chi <= free + s.merge_z * math.sqrt(2 * free) + 1e-6 and same:
                name = "{any of " + main[seg] + "}"
            if len(group) > s.most_children and n < s.rare_share * sum(c[0] for c in group.values()):
                name = "{*}"
            names[node, seg] = name
    templates = ["".join("/" + names[(h, segs[:k]), seg] for k, seg in enumerate(segs)) for h, segs in where]
    of_template, of_host = (collections.defaultdict(lambda: [0, 0]) for _ in range(2))
    for (h, _), t, bad in zip(where, templates, bad_of):
        for x in (of_template[h, t], of_host[h]):
            x[0] += bad is not None
            x[1] += bad or 0
    labelled = [b for b in bad_of if b is not None]
    everywhere = (sum(labelled) + s.prior_bad * (len(urls) - len(labelled))) / len(urls)
    out = []
    for (h, _), t in zip(where, templates):
        host = (of_host[h][1] + s.global_weight * everywhere) / (of_host[h][0] + s.global_weight)
        out.append((t, (of_template[h, t][1] + s.host_weight * host) / (of_template[h, t][0] + s.host_weight)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_and_purity_are_those_of_plain_python(spark, seed):
    r = random.Random(seed)
    words = ["buy", "en", "de", "user", "tag", "news", "about", "x1", "2024", "a" * 90]
    urls = [None, "none"] + [f"http://h{int(r.random() ** 3 * 5)}.com" + "".join("/" + r.choice(words[: 3 + 3 * k]) for k in range(r.randrange(6))) for _ in range(600)]
    bad = [None if r.random() < 0.5 else int(("buy" in (u or "")) ^ (r.random() < 0.1)) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if b is not None], "id long, bad int")
    got = {x["page_id"]: x for x in url_filters.filter_urls(pages, [], labels, settings=S).collect()}
    want = plain(urls, bad, S)
    assert len(got) == len(urls)
    for i, (template, share) in enumerate(want):
        assert got[i]["template"] == template and math.isclose(got[i]["bad_share"], share, rel_tol=1e-9)
        assert got[i]["verdict"] == ("block" if share >= S.reject_at else "allow")
    assert len({t for t, _ in want if "any of" in t}) > 1 and any("{*}" in t for t, _ in want) and {x["verdict"] for x in got.values()} == {"block", "allow"}


def test_pages_without_a_rule_are_blocked_and_allowed(spark):
    queries = pytest.importorskip("larkspur.llm.queries")
    out = queries.op7_url_filters(spark, "/root/testdata/sf0.1")
    free = {r["verdict"]: r["count"] for r in out.where("rule is null").groupBy("verdict").count().collect()}
    assert free["block"] > 10 and free["allow"] > 10
    assert out.count() == spark.read.parquet("/root/testdata/sf0.1/pages.parquet").count()
    # beside pages that a rule blocks, and beside pages that one allows
    assert out.where("rule is null and host like '%.org'").where(F.col("verdict") == "block").count() == 0
