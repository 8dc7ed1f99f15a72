"""Operator 7, URL filters: a path-template tree.

Per host, paths form a tree of segments. Segments that vary (numbers, keys, or any child of a node with
too many rare children) become wildcards; sibling branches become one where neither what follows them nor
their labels differ statistically, so labelled pages speak for unlabelled ones beside them; and a template is
rejected when the labelled pages under it are bad almost always, after smoothing towards its host and all
hosts. The tree is built over distinct generalised paths with counts, never over pages.
Explicit rules, where one fits, come before the method.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import met, new_name, saved


@dataclass(frozen=True)
class Rule:
    """verdict ("block" or "allow") for a host and its subdomains, where the path starts with the rule's: `host/path`."""

    pattern: str
    verdict: str


@dataclass(frozen=True)
class TreeSettings:
    #: Levels of the tree; what lies deeper is one wildcard.
    depth: int = 6
    #: A node with more children than this generalises those with a smaller share of its pages than rare_share.
    most_children: int = 24
    rare_share: float = 0.05
    #: Standard errors by which a branch may differ, in what follows it and in labels, from its siblings together and still be merged.
    merge_z: float = 2.0
    #: Labelled pages that the host counts for, and all hosts together.
    host_weight: float = 2.0
    global_weight: float = 2.0
    #: Share of bad ones among pages without a label, for the share of all pages.
    prior_bad: float = 0.1
    #: A template is rejected from this smoothed share of bad pages on.
    reject_at: float = 0.8


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        name, _, rest = r.pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def generalised(path: Column, depth: int) -> Column:
    """Segments of a path with numbers, dates and keys as wildcards; a `{**}` stands for what is deeper."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        s = F.regexp_replace(s, r"(?i)[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}", "{key}")
        s = F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{12,}\b", "{key}")
        s = F.regexp_replace(s, r"[0-9]+", "{n}")
        return F.when(F.length(s) > 80, F.lit("{long}")).otherwise(s)

    shaped = F.transform(segments, shape)
    return F.when(F.size(shaped) > depth, F.concat(F.slice(shaped, 1, depth), F.array(F.lit("{**}")))).otherwise(shaped)


def templates(paths: DataFrame, s: TreeSettings = TreeSettings()) -> DataFrame:
    """(host, shape, template) for paths (host, shape, n, labelled, bad).

    A child of a node of the tree is one segment below one prefix, with the kinds of what follows it (its
    shape with words as `w`) and how many pages each has. All nodes are judged at once: rare children become
    `{*}`, alike ones `{any of <their most frequent kind>}`, and a path's template is the names along it.
    """
    step = paths.select("host", "shape", "n", "labelled", "bad", F.posexplode("shape").alias("level", "seg"))
    kind = F.regexp_replace(F.concat_ws("/", F.slice("shape", F.col("level") + 2, F.size("shape"))), r"[^/{}]+(?![^/{}]*\})", "w")
    step = saved(step.select("*", F.slice("shape", F.lit(1), F.col("level")).alias("prefix"), kind.alias("kind")))
    node = ["host", "prefix"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    kinds = step.groupBy(*node, "seg", "kind").agg(*sums, F.count(F.lit(1)).alias("paths"))
    child = kinds.groupBy(*node, "seg").agg(*sums, F.sum("paths").alias("paths"), F.collect_list(F.struct("n", "kind")).alias("kinds"))  # kinds are few: words are all `w`
    child = saved(child.withColumn("main", F.array_max("kinds")["kind"]))
    pool = child.select(*node, "main", F.explode("kinds").alias("k")).groupBy(*node, "main", "k.kind").agg(F.sum("k.n").alias("held"))
    pool = pool.groupBy(*node, "main").agg(F.map_from_entries(F.collect_list(F.struct("kind", "held"))).alias("pool"), F.sum("held").alias("pool_n"))
    stats = child.groupBy(*node, "main").agg(F.count(F.lit(1)).alias("branches"), F.sum("labelled").alias("pool_l"), F.sum("bad").alias("pool_b"))
    whole = child.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("node_n"))
    pool = pool.join(stats, [*node, "main"]).join(whole, node)
    found = ["pool", "pool_n", "branches", "pool_l", "pool_b", "children", "node_n"]
    rows = met(child, pool, [(c, c) for c in (*node, "main")], found, "branches", child.count())
    rare = (F.col("children") > s.most_children) & (F.col("n") < s.rare_share * F.col("node_n"))
    # chi-squared of the child's kinds against those of all branches with the same most frequent kind
    chi = F.aggregate("kinds", F.lit(0.0), lambda x, k: x + k["n"] * k["n"] * F.col("pool_n") / (F.col("n") * F.element_at("pool", k["kind"]))) - F.col("n")
    free = F.size("pool") - 1
    same_kinds = chi <= free + s.merge_z * F.sqrt(2 * free) + 1e-6
    p = (F.col("pool_b") + 0.5) / (F.col("pool_l") + 1)
    same_labels = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.col("labelled") - p) <= s.merge_z * F.sqrt(p * (1 - p) / F.col("labelled")))
    alike = (F.col("branches") > 1) & (F.col("main") != "") & same_kinds & same_labels
    name = F.when(rare, "{*}").when(alike, F.concat(F.lit("{any of "), "main", F.lit("}"))).otherwise(F.col("seg"))
    names = saved(rows.select(*node, "seg", "paths", name.alias("name")))
    named = met(step.select("host", "shape", "level", "prefix", "seg"), names, [(c, c) for c in (*node, "seg")], ["name"], "paths", step.count())
    along = F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"])
    tree = named.groupBy("host", "shape").agg(F.concat(F.lit("/"), F.array_join(along, "/")).alias("template"))
    return saved(tree.unionByName(paths.where(F.size("shape") == 0).select("host", "shape", F.lit("").alias("template"))))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", settings: TreeSettings = TreeSettings()) -> DataFrame:
    """pages with host, path, rule, template, bad_share and verdict ("block" or "allow"); one row per input row.

    labels: (id, bad) of some pages; without it, pages that a rule fits are the labelled ones, bad if it
    blocks them, so that pages beside them, which no rule fits, are judged by likeness. bad_share is the share
    of bad pages among the template's labelled ones, smoothed towards the host's, and that towards the share
    of all pages, where one without a label counts as prior_bad. A null url, or one without "://", has an
    empty host and path, fits no rule and is judged with others like it. Repeated rows are judged alike, and
    count each; long paths are one wildcard below settings.depth; an empty table gives an empty one. Input
    columns named like an output column are replaced.
    """
    s = settings
    outputs = ("host", "path", "rule", "template", "bad_share", "verdict")
    kept = [c for c in pages.columns if c.lower() not in outputs]
    url = pages[url_col].cast("string")
    rows = pages.select(*(pages[c] for c in kept), *([] if id_col in kept else [pages[id_col].alias(id_col)]), host_of(url).alias("host"), path_of(url).alias("path"))
    fit, shape = new_name(rows, "fit"), new_name(rows, "shape")
    rows = rows.withColumn(fit, fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(shape, generalised(F.col("path"), s.depth))
    if labels is None:
        seen = rows.select("host", F.col(shape).alias("shape"), F.when(F.col(fit).isNotNull(), (F.col(f"{fit}.verdict") == "block").cast("int")).alias("is_bad"))
    else:
        known = labels.select(F.col(labels.columns[0]).alias("label_id"), F.col(labels.columns[1]).cast("int").alias("is_bad")).groupBy("label_id").agg(F.max("is_bad").alias("is_bad"))
        seen = rows.select(F.col(id_col).alias("row_id"), "host", F.col(shape).alias("shape")).join(known, F.col("row_id") == F.col("label_id"), "left").select("host", "shape", "is_bad")
    paths = saved(seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad")))
    total, labelled, bad, shapes = paths.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "labelled", "bad")), F.count(F.lit(1))).first()
    everywhere = (bad + s.prior_bad * (total - labelled)) / max(total, 1)

    tree = saved(templates(paths, s).join(paths, ["host", "shape"]))  # one row each
    share = saved(tree.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"), F.count(F.lit(1)).alias("shapes")))
    of_host = share.groupBy("host").agg(F.sum("tl").alias("hl"), F.sum("tb").alias("hb"), F.count(F.lit(1)).alias("templates"))
    share = met(share, of_host, [("host", "host")], ["hl", "hb"], "templates", share.count())
    host_bad = (F.col("hb") + s.global_weight * everywhere) / (F.col("hl") + s.global_weight)
    share = share.select("host", "template", "shapes", ((F.col("tb") + s.host_weight * host_bad) / (F.col("tl") + s.host_weight)).alias("bad_share"))
    judged = saved(met(tree.select("host", "shape", "template", "n"), share, [("host", "host"), ("template", "template")], ["bad_share"], "shapes", shapes))

    out = met(rows, judged, [("host", "host"), (shape, "shape")], ["template", "bad_share"], "n", total)
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col("bad_share") >= s.reject_at, "block").otherwise("allow"))
    return out.select(*kept, "host", "path", F.col(f"{fit}.rule").alias("rule"), "template", "bad_share", verdict.alias("verdict"))


def path_rules(patterns: dict[str, str]) -> list[Rule]:
    for verdict in patterns.values():
        if verdict not in ("block", "allow"):
            raise ValueError(f"{verdict} is not block or allow")
    return [Rule(p, v) for p, v in patterns.items()]

