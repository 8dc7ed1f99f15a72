"""Operator 9, MinHash near-dedup by bottom-k sketches from one hash function.

1. Each document gives its set of shingle hashes and, as its sketch, the SKETCH smallest of them. Equal
   sets are one class from here on, so exact copies cost one row.
2. Inverted lists of retained values. Similar documents share well over NEED of SKETCH values, so a class
   with fewer values in lists of two or more can't have a partner, and for the others the rarest values,
   all but NEED - 1, are enough to meet each partner in a list. A list is linked to its best-connected
   member only: the components of these stars are clusters outside of which nothing is similar.
3. Clusters are split into blocks of bounded size. Inside a block, union-sketch estimates filter the pairs
   and exact Jaccard on the full sets verifies them, in numpy; links leave as a star per component. Each
   block also holds the cluster's hubs, which ties the blocks together.
4. Members that are still apart from their cluster's main component are compared with all blocks of the
   cluster, block against block. So no link between different components is lost, and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped_text, met, new_name, saved, ship, without
from .components import components

SHINGLE = 5
SKETCH = 64
NEED = 28  # of SKETCH: at similarity 0.75 two sketches share 48 or so, 28 at least but for one pair in 10**8
HUBS = 2
#: A block has at most about so many classes and bytes of sets.
BLOCK_CLASSES = 600
BLOCK_BYTES = 24_000_000
#: Union-sketch estimates below this don't go on to be verified: six standard deviations below 0.75.
ESTIMATE = NEED / SKETCH


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct 5-word shingles of each text as sorted 64-bit hashes; all words as one if they are fewer."""
    from .bytewords import MIX, mixed, word_hashes, words_of

    data, _, starts, sizes, doc = words_of(texts, lower=True)
    words = word_hashes(data, starts, sizes)
    count = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(count) - count
    n = max(0, len(words) - SHINGLE + 1)
    key = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        key = mixed(key * MIX + words[j : j + n])
    out = []
    for b, c in zip(begin.tolist(), count.tolist()):
        if c >= SHINGLE:
            out.append(np.unique(key[b : b + c - SHINGLE + 1]))
        elif c:
            one = np.array([c], np.uint64)
            for i in range(b, b + c):
                one = mixed(one * MIX + words[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """keep and (doc_id, n_shingles, set_key, sketch): set_key is a 128-bit hash of the set as hex, null for an empty set."""

    def work():
        import hashlib

        def fn(texts):
            sets = shingle_sets(texts)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            return None, [[len(s) for s in sets], keys, [s[:SKETCH].view(np.int64).tolist() for s in sets]]

        return fn

    rows = docs.select(*keep, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped_text(rows, "text", "n_shingles long, set_key string, sketch array<long>", work)


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles): full sets, as bytes, of the wanted doc_ids (whose text is read again, not kept)."""

    def work():
        def fn(texts):
            return None, [[s.tobytes() for s in shingle_sets(texts)]]

        return fn

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped_text(rows.join(wanted, "doc_id", "left_semi"), "text", "shingles binary", work)


def union_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of pairs of sketches (rows, ascending, padded with the largest value): the share of
    values in both among the smallest SKETCH of their union."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    pad = both == np.uint64(0xFFFFFFFFFFFFFFFF)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    again &= ~pad
    rank = np.cumsum(~again & ~pad, axis=1)
    inside = (rank <= SKETCH) & ~pad
    return (again & inside).sum(1) / np.maximum((~again & inside).sum(1), 1)


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(m, 2) indices of pairs of a left and a right set with 100 * intersection >= 75 * union; estimates first, then full sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    sketch = np.full((len(sets), SKETCH), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i, s in enumerate(sets):
        sketch[i, : min(SKETCH, len(s))] = s[:SKETCH]
    shared = _overlaps([s[:SKETCH] for s in sets], left, right)
    small = np.minimum(np.minimum(sizes[left][:, None], sizes[right][None, :]), SKETCH)
    may = shared * SKETCH >= NEED * small
    may &= 4 * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= 3 * np.maximum(sizes[left][:, None], sizes[right][None, :])
    i, j = np.nonzero(may)
    ok = left[i] != right[j]
    i, j = i[ok], j[ok]
    keep = [np.zeros(0, bool)]
    for k in range(0, len(i), 10_000):
        keep.append(union_estimates(sketch[left[i[k : k + 10_000]]], sketch[right[j[k : k + 10_000]]]) >= ESTIMATE)
    keep = np.concatenate(keep)
    i, j = i[keep], j[keep]
    if not len(i):
        return np.zeros((0, 2), np.int64)
    li, lj = np.unique(i), np.unique(j)
    if len(li) * len(lj) <= 4 * len(i):
        both = _overlaps(sets, left[li], right[lj])[np.searchsorted(li, i), np.searchsorted(lj, j)]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left[i], right[j])])
    union = sizes[left[i]] + sizes[right[j]] - both
    good = 100 * both >= 75 * union
    return np.stack([left[i[good]], right[j[good]]], axis=1)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of 0/1 matrices over some values at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.concatenate([sets[k] for k in x]) if len(x) else np.zeros(0, np.uint64) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(sets[k]) for k in x]) for x in (left, right)]
    common = np.intersect1d(rows[0], rows[1])
    if left is right or np.array_equal(left, right):  # values of one set alone don't matter
        values, n = np.unique(rows[0], return_counts=True)
        common = values[n > 1]
    order = [np.argsort(x, kind="stable") for x in rows]
    rows, owner = [x[o] for x, o in zip(rows, order)], [x[o] for x, o in zip(owner, order)]
    for k in range(0, len(common), width):
        part = common[k : k + width]
        m = []
        for x, o, n in zip(rows, owner, (len(left), len(right))):
            a, b = np.searchsorted(x, part[0]), np.searchsorted(x, part[-1], side="right")
            at = np.minimum(np.searchsorted(part, x[a:b]), len(part) - 1)
            hit = part[at] == x[a:b]
            dense = np.zeros((n, len(part)), np.float32)
            dense[o[a:b][hit], at[hit]] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _stars(nodes: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of the pairs (indices of nodes): (member, smallest member)."""
    top = list(range(len(nodes)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if nodes[a] < nodes[b]:
            top[b] = a
        else:
            top[a] = b
    return [(nodes[i], nodes[find(i)]) for i in range(len(nodes)) if find(i) != i]


def _links(groups: DataFrame) -> DataFrame:
    """Verified links (u, v) inside each (cluster, block). Members with side 0 are compared with those of side 1,
    those of side 2 with all; links of one component leave as a star. Groups stand together in a partition."""

    def run(batches):
        import pyarrow as pa

        now, nodes, sides, sets = None, [], [], []

        def flush():
            side = np.array(sides)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            stars = _stars(nodes, similar_pairs(sets, left, right)) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            for cluster, block, node, side, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "doc_id", "side", "shingles"))):
                if (cluster, block) != now:
                    if len(nodes) > 1:
                        yield flush()
                    now, nodes, sides, sets = (cluster, block), [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(nodes) > 1:
            yield flush()

    dealt = groups.repartition(F.col("cluster"), F.col("block")).sortWithinPartitions("cluster", "block")
    return dealt.select("cluster", "block", "doc_id", "side", "shingles").mapInArrow(run, "u long, v long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep and (doc_id, n_shingles, component_id, kept), one row per input row.

    Words are runs of other characters than [\\x20\\x09-\\x0D], A-Z in lower case; a document's set holds its
    distinct 5-word shingles, or its whole sequence of words if it has fewer. Documents are linked where
    100 * intersection >= 75 * union; component_id is the smallest id reachable, kept marks its document.
    Documents without words have an empty set and are linked with nothing. Rows with one id are one
    document, linked where any of its rows is, and all kept or dropped. Rows with a null id are linked with
    nothing: their component is null, and they are kept. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    sketches = saved(_sketches(docs, id_col, text_col, list(keep)))
    real = sketches.where("set_key is not null and doc_id is not null")
    classes = real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.any_value("sketch").alias("sketch"))
    classes = saved(classes.withColumn("class_no", F.monotonically_increasing_id()))

    # inverted lists, of values that two classes or more retain
    posts = classes.select("class_no", F.explode("sketch").alias("value"))
    listed = posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = met(posts, listed.withColumn("rows", F.col("df")), [("value", "value")], ["df"], "rows", classes.agg(F.sum(F.size("sketch"))).first()[0] or 0)
    active = shared.groupBy("class_no").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("post"))  # at most SKETCH values a class
    m = F.size("sketch")
    need = F.ceil(m * F.lit(NEED) / SKETCH).cast("int")
    active = active.join(classes.select("class_no", F.col("rep").alias("doc_id"), need.alias("need"), m.alias("m")), "class_no").where(F.size("post") >= F.col("need"))
    # the rarest m - need + 1 of all retained values; those that no other class has come first and list nobody
    first = F.greatest(F.size("post") - F.col("need") + 1, F.lit(0))
    active = active.select("doc_id", F.slice("post", F.lit(1), first).alias("post"), F.aggregate("post", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("degree"))
    lists = saved(active.select("doc_id", "degree", F.explode("post.value").alias("value")))
    active = lists.groupBy("doc_id").agg(F.max("degree").alias("degree"))
    hubs = lists.groupBy("value").agg(F.max(F.struct(F.col("degree"), (-F.col("doc_id")).alias("no"))).alias("hub"), F.count(F.lit(1)).alias("rows"))
    stars = met(lists, hubs, [("value", "value")], ["hub"], "rows", lists.count()).select(F.col("doc_id").alias("u"), (-F.col("hub.no")).alias("v")).where("u <> v").distinct()
    clusters = saved(components(stars).select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")))

    # full sets of cluster members, from their texts
    sets = _sets_of(docs, clusters.select("doc_id"), id_col, text_col)
    members = sets.join(clusters, "doc_id").join(active, "doc_id").dropDuplicates(["doc_id", "shingles"])
    members = saved(members.where(F.length("shingles") > 0))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    size = saved(size.select("cluster", "n", F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    placed = met(members, size, [("cluster", "cluster")], ["blocks"], "n", members.count()).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    large = size.where("blocks > 1")
    # the best-connected members of a large cluster go to all its blocks
    top = placed.where("blocks > 1").groupBy("cluster", "blocks").agg(F.max(F.struct(F.col("degree"), (-F.col("doc_id")).alias("no"))).alias("a"), F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("no"))).alias("b"))
    top = top.select(F.explode(F.array(-F.col("a.no"), F.col("b.no"))).alias("hub"), "cluster", "blocks").distinct()
    top = members.join(top.select(F.col("hub").alias("doc_id"), "blocks"), "doc_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["cluster", "block", "doc_id", "side", "shingles"]
    within = placed.withColumn("side", F.lit(2)).select(columns).unionByName(top.withColumn("side", F.lit(2)).select(columns).join(placed.select("cluster", "block", "doc_id"), ["cluster", "block", "doc_id"], "left_anti"))
    links = saved(_links(within))

    # what is still apart in large clusters, against all blocks
    if large.limit(1).count():
        label = components(links)
        parts = placed.where("blocks > 1").join(label, F.col("doc_id") == F.col("node"), "left").withColumn("part", F.coalesce("label", "doc_id")).drop("node", "label")
        parts = saved(parts)
        sizes = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("x")).select("cluster", F.col("x.part").alias("main"))
        apart = parts.join(main, "cluster").where("part <> main")
        room = apart.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("queries"), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES).cast("int").alias("q2"))
        room = saved(room.select("cluster", F.greatest("queries", "q2").alias("queries")))
        asked = apart.join(room, "cluster").withColumn("q", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("queries")).cast("int"))
        asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
        data = parts.join(room, "cluster").withColumnRenamed("block", "b").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("queries") - 1))).withColumn("side", F.lit(1))
        cross = asked.select("cluster", "q", "b", "blocks", "doc_id", "side", "shingles").unionByName(data.select("cluster", "q", "b", "blocks", "doc_id", "side", "shingles"))
        cross = cross.withColumn("block", F.col("q") * F.col("blocks") + F.col("b"))
        links = saved(links.unionByName(_links(cross.select(columns))))

    # an id with several sets joins the classes of all of them
    loose = real.join(classes, "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    twice = real.groupBy("doc_id").agg(F.countDistinct("set_key").alias("sets")).where("sets > 1").select(F.col("doc_id").alias("u"))
    extra = loose.join(twice, "u", "left_semi")
    label = saved(components(links.unionByName(extra)))

    of_class = saved(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("class_label"), "rows"))
    # rows of large groups of copies, and rows without a set, stay where they are
    with_set = met(sketches.where("set_key is not null").drop("sketch"), of_class, [("set_key", "set_key")], ["class_label"], "rows", sketches.count(), "left")
    out = with_set.unionByName(sketches.where("set_key is null").drop("sketch").withColumn("class_label", F.lit(None).cast("long")))
    own = label.join(twice.withColumnRenamed("u", "node"), "node", "left_semi").select(F.col("node").alias("own_id"), F.col("label").alias("own"))
    out = out.join(own, F.col("doc_id") == F.col("own_id"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("own", "class_label", "doc_id"))
    return out.select(*keep, "doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose document is not the first of its component (see near_components, also for
    nulls, empty texts and repeated rows). Columns stay as they are, and an empty table gives an empty one."""
    row_no = new_name(docs, "row_no")
    rows = docs.withColumn(row_no, F.monotonically_increasing_id())
    narrow = rows.select(F.col(row_no).alias("row_no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dropped = near_components(narrow, "id", "text", ["row_no"]).where("not kept").select("row_no")
    return without(rows, row_no, dropped).select(*(rows[c] for c in docs.columns))
