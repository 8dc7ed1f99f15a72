"""Operator 4, quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Training counts the byte n-grams of all trusted texts in Spark; the counts of lower orders, the discounts,
the weights of contexts and the probabilities follow from joins and aggregations of hash-partitioned count
tables. Scoring is a sharded count join: tasks count the n-grams of a block of texts by document, send these
counts, not the texts, to the shards of the model, and what a shard says of a block's documents is added up
by block. A shard is found by the last two bytes of a context, so it answers every order of its n-grams by
itself; shards and blocks are bounded, and neither the model nor counts ever meet the driver or a broadcast.
A document is rejected if its perplexity is far above what held-out trusted text of its language has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster
from .cluster import new_name, saved, ship, without

ORDER = 5
#: Entries of a shard of the model (12 bytes each in a task), and the least number of shards.
SHARD_ENTRIES = 4_000_000
LEAST_SHARDS = 16
#: Bytes of the texts whose counts travel together, and of those that one task joins with its shard.
BLOCK_BYTES = 2_000_000
TASK_BYTES = 256_000_000
#: Entries of the model in a row on their way to their shard.
CHUNK_ENTRIES = 200_000


def text_blocks(batches, order: int, most_bytes: int | None = None, most_parts: int = 1 << 16) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(row_no of each part, its bytes) of about BLOCK_BYTES in all, from batches (row_no, text).

    A part has the order - 1 bytes before it in front, zeros at a text's begin. A text that is longer than
    what a block has left goes on in the next, so blocks stay small whatever the texts' lengths.
    """
    most_bytes = most_bytes or BLOCK_BYTES
    zeros = np.zeros(order - 1, np.uint8)
    owners, parts, held = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column("row_no").to_pylist(), batch.column("text")):
            data, at = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else zeros[:0], 0
            while at < len(data):
                end = min(len(data), at + most_bytes - held)
                before = data[max(0, at - order + 1) : at]
                parts.append(np.concatenate([zeros[len(before) :], before, data[at:end]]))
                owners.append(row)
                held, at = held + end - at, end
                if held == most_bytes or len(parts) == most_parts:
                    yield owners, parts
                    owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


def byte_grams(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at each byte of all parts, number of bytes of each part); see text_blocks."""
    data = np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(np.uint64)
    sizes = np.fromiter((len(p) - order + 1 for p in parts), np.int64, len(parts))
    key = np.zeros(max(0, len(data) - order + 1), np.uint64)
    for j in range(order):
        key = key << np.uint64(8) | data[j : j + len(key)]
    begin = np.cumsum(sizes + order - 1) - sizes - order + 1
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return key[at], sizes


def gram_counts(docs: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """(gram, c): how often each n-gram of bytes, as a number, occurs in all texts. Tasks add up their own first."""
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6: an n-gram and a place in its block share 64 bits")
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def merged(parts):
            keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["gram", "c"])

        held = []
        for _, parts in text_blocks(batches, order):
            grams, _ = byte_grams(parts, order)
            held.append(tuple(x.astype(t) for x, t in zip(np.unique(grams, return_counts=True), (np.uint64, np.int64))))
            if len(held) >= 16:
                held = [merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield out(*held.pop())
        if held:
            yield out(*merged(held))

    texts = docs.select(F.lit(0).alias("row_no"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, n, gram, weight): log probability of each n-gram seen (kind 0), log weight of each context (kind 1).

    Below the highest order, counts are numbers of distinct bytes before. Each order subtracts its own three
    discounts and hands what they leave, by context, to the order below; the lowest hands it to all bytes alike.
    """
    levels = {order: saved(counts)}
    for n in range(order - 1, 0, -1):
        mask = (1 << (8 * n)) - 1
        levels[n] = saved(levels[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    of_counts = [levels[n].agg(F.lit(n).alias("n"), *(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))) for n in levels]
    table = of_counts[0]
    for t in of_counts[1:]:
        table = table.unionByName(t)
    out, below = None, None
    stats = {r["n"]: r for r in table.collect()}  # a row per order
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, stats[n][f"n{i}"]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts = [min(max(d, 0.01), i - 0.01) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        cut = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        grams = levels[n].withColumn("cut", cut).withColumn("context", F.shiftright("gram", 8))
        contexts = grams.groupBy(F.col("context").alias("x")).agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("left"))
        grams = grams.join(contexts, F.col("context") == F.col("x"))
        if below is None:
            lower = F.lit(1 / 256)
        else:
            grams = grams.join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1)) == F.col("shorter"))
            lower = F.col("q")
        below = saved(grams.select("gram", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("left") * lower).alias("p")))
        part = below.select(F.lit(0).alias("kind"), F.lit(n).alias("n"), "gram", F.log("p").alias("weight"))
        part = part.unionByName(contexts.select(F.lit(1).alias("kind"), F.lit(n).alias("n"), F.col("x").alias("gram"), F.log("left").alias("weight")))
        out = part if out is None else out.unionByName(part)
    return saved(out)


def shard_of(pair, shards: int):
    """The shard of the last two bytes of a context, as numbers or as a Column."""
    return (pair * 40503) % 65536 % shards


class Shard:
    """A part of the model as sorted arrays by kind and order."""

    def __init__(self, order: int, chunks: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.order, self.tables = order, {}
        for kind in (0, 1):
            for n in range(1, order + 1):
                own = [(keys, weights) for k, m, keys, weights in chunks if (k, m) == (kind, n)]
                keys, weights = (np.concatenate(x) for x in zip(*own)) if own else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
                by = np.argsort(keys)
                self.tables[kind, n] = keys[by], weights[by]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram of this shard."""
        out = np.zeros(len(grams))
        at, keys = np.arange(len(grams)), grams
        for n in range(self.order, 0, -1):
            p, hit = self._look(0, n, keys)
            out[at[hit]] += p[hit]
            at, keys = at[~hit], keys[~hit]
            if not len(at):
                return out
            weight, known = self._look(1, n, keys >> np.uint64(8))
            out[at[known]] += weight[known]
            keys = keys & np.uint64((1 << (8 * (n - 1))) - 1)
        out[at] += math.log(1 / 256)
        return out

    def _look(self, kind: int, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, weights = self.tables[kind, n]
        if not len(known):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return weights[at], known[at] == keys


def sharded(model: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, n, gram, weight): the model with the shard that each entry belongs to. Orders 1 and 2, at
    most 66,049 entries, are in all."""
    context = F.when(F.col("kind") == 0, F.shiftright("gram", 8)).otherwise(F.col("gram"))
    one = shard_of(context.bitwiseAND(F.lit(0xFFFF)), shards).cast("int")
    large = model.where("n > 2").select(one.alias("shard"), "kind", "n", "gram", "weight")
    small = model.where("n <= 2").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "kind", "n", "gram", "weight")
    return large.unionByName(small)


def _squeezed(x: np.ndarray) -> bytes:
    """An array byte plane by byte plane, compressed."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    return pa.Codec("zstd", compression_level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def _restored(raw: bytes, kind: type, count: int) -> np.ndarray:
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, decompressed_size=count * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).reshape(-1)


def _rows(batch) -> Iterator[dict]:
    """The rows of a batch one by one, since they are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


MODEL = "struct<kind:int,n:int,entries:int,keys:binary,weights:binary>"
COUNTS = "struct<grams:int,pairs:int,docs:int,gram:binary,per:binary,doc:binary,times:binary,owner:binary>"


def block_counts(parts: list[np.ndarray], owners: list[int], order: int, shards: int) -> Iterator[tuple[int, tuple]]:
    """(shard, fields of COUNTS): the distinct n-grams of a block that the shard knows, how many documents have
    each, which ones, and how often. The first shard's also names the documents."""
    grams, sizes = byte_grams(parts, order)
    keys = np.sort(grams << np.uint64(16) | np.repeat(np.arange(len(parts), dtype=np.uint64), sizes))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    times = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
    keys = keys[first]
    shard = shard_of(np.arange(1 << 16), shards).astype(np.uint16)[keys >> np.uint64(24) & np.uint64(0xFFFF)]
    by = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    for s in range(shards):
        at = by[cuts[s] : cuts[s + 1]]
        if not len(at) and s:
            continue
        gram = keys[at] >> np.uint64(16)
        new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(at) else np.zeros(0, np.int64)
        doc = (keys[at] & np.uint64(0xFFFF)).astype(np.uint16)
        owner = _squeezed(np.array([owners, sizes], np.int64).reshape(-1)) if s == 0 else None
        yield s, (len(new), len(at), len(parts), _squeezed(np.diff(gram[new], prepend=np.uint64(0))), _squeezed(np.diff(np.r_[new, len(at)]).astype(np.uint32)), _squeezed(np.diff(doc, prepend=np.uint16(0))), _squeezed(times[at]), owner)


def scores(docs: DataFrame, model: DataFrame, row_no: str, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(row_no, text_bytes, log_prob): the number of bytes of each text and the sum of their log probabilities.

    Rows with an empty or null text have none. row_no tells rows apart.
    """
    spark = docs.sparkSession
    ship(spark)
    entries = model.count()
    shards = max(LEAST_SHARDS, -(-entries // SHARD_ENTRIES))
    texts = docs.select(F.col(row_no).alias("row_no"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    copies = max(1, -(-total // (shards * TASK_BYTES)))  # tasks that share a shard's part of the texts

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        names = [f.split(":")[0] for f in COUNTS[7:-1].split(",")]
        for owners, parts in text_blocks(batches, order):
            rows = list(block_counts(parts, owners, order, shards))
            fields = [pa.array(x, t) for x, t in zip(zip(*(r for _, r in rows)), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.StructArray.from_arrays(fields, names)], names=["shard", "block", "counts"])
            number += 1

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            shard, kind, n, gram, weight = (batch.column(i).to_numpy() for i in range(5))
            by = np.lexsort((n, kind, shard))
            place = (shard[by].astype(np.int64) * 2 + kind[by]) * (order + 1) + n[by]
            edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            cuts = [(b, min(b + CHUNK_ENTRIES, e)) for a, e in zip(edge, edge[1:]) for b in range(a, e, CHUNK_ENTRIES)]
            fields = [pa.array([int(x[by[b]]) for b, _ in cuts], pa.int32()) for x in (kind, n)] + [pa.array([int(e - b) for b, e in cuts], pa.int32())]
            fields += [pa.array([x[by[b:e]].astype(t).tobytes() for b, e in cuts], pa.binary()) for x, t in ((gram, "<u8"), (weight, "<f4"))]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[by[b]]) for b, _ in cuts], pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "n", "entries", "keys", "weights"])], names=["shard", "model"])

    def join(batches):
        import pyarrow as pa

        now, chunks, shard = None, [], None
        for batch in batches:
            for row in _rows(batch):
                if (row["shard"], row["copy"]) != now:
                    now, chunks, shard = (row["shard"], row["copy"]), [], None
                if row["model"] is not None:
                    m = row["model"]
                    chunks.append((m["kind"], m["n"], np.frombuffer(m["keys"], "<u8"), np.frombuffer(m["weights"], "<f4")))
                    continue
                shard = shard or Shard(order, chunks)
                chunks, c = [], row["counts"]
                gram = np.cumsum(_restored(c["gram"], np.uint64, c["grams"]), dtype=np.uint64)
                says = np.repeat(shard.log_probability(gram), _restored(c["per"], np.uint32, c["grams"]))
                doc = np.cumsum(_restored(c["doc"], np.uint16, c["pairs"]), dtype=np.uint16)
                sums = np.bincount(doc, says * _restored(c["times"], np.uint32, c["pairs"]), c["docs"])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([c["owner"]], pa.binary())], names=["block", "sums", "owner"])

    def add(batches):
        import pyarrow as pa

        now, sums, owner = None, None, None

        def flush():
            rows, sizes = _restored(owner, np.int64, 2 * len(sums)).reshape(2, -1)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sizes), pa.array(sums)], names=["row_no", "text_bytes", "log_prob"])

        for batch in batches:
            for row in _rows(batch):
                if row["block"] != now:
                    if now is not None:
                        yield flush()
                    now, sums, owner = row["block"], 0.0, None
                sums, owner = sums + np.frombuffer(row["sums"]), row["owner"] or owner
        if now is not None:
            yield flush()

    counted = texts.mapInArrow(count, f"shard int, block long, counts {COUNTS}")
    counted = counted.select("shard", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), F.lit(None).cast(MODEL).alias("model"), "block", "counts")
    entries = sharded(model, shards).select("shard", "kind", "n", "gram", "weight").repartition("shard").mapInArrow(pack, f"shard int, model {MODEL}")
    entries = entries.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "model", F.lit(None).cast("long").alias("block"), F.lit(None).cast(COUNTS).alias("counts"))
    # a shard's entries stand before the counts that ask it; more partitions than groups, so that few of them meet in one
    met = entries.unionByName(counted).repartition(int(3 * shards * copies), "shard", "copy").sortWithinPartitions("shard", "copy", F.col("model").isNull())
    said = met.mapInArrow(join, "block long, sums binary, owner binary")
    said = said.repartition("block").sortWithinPartitions("block").mapInArrow(add, "row_no long, text_bytes long, log_prob double")
    return said.groupBy("row_no").agg(F.sum("text_bytes").alias("text_bytes"), F.sum("log_prob").alias("log_prob"))


def levels_by_language(sample: DataFrame, quantile: float, margin: float) -> tuple[DataFrame, tuple[float, float, float]]:
    """(lang, n, level, spread, threshold) of each language, null too, and (level, spread, threshold) of one without any sample.

    sample: (lang, bits, text_bytes) of held-out documents. A level is the median of the language's own bits,
    drawn towards the mean of all languages' medians by as much as its error (which falls with the documents)
    weighs against the differences between languages. spread: what is left of its error, in units in which a
    document of b bytes has the error 1 / b. A threshold is the quantile itself and margin of its standard errors
    above, which vanish as documents grow. That of a language weighs by its documents against the pooled one,
    which counts for as many documents as hold one beyond the quantile.
    """
    own = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("bits", 0.5, 100_000).alias("m"), F.sum(1 / F.col("text_bytes")).alias("e"))
    own = saved(own.select("lang", "n", "m", (F.lit(math.pi / 2) * F.col("e") / F.col("n") / F.col("n")).alias("v")))
    mean, apart, error = own.agg(F.avg("m"), F.coalesce(F.var_samp("m"), F.lit(0.0)), F.avg("v")).first()
    if mean is None:  # nothing was held out
        return own.select("lang", "n", F.lit(0.0).alias("level"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("threshold")), (8 * math.log(2), 0.0, 0.0)
    renamed = own.select(F.col("lang").alias("l"), "n", "m")
    # a document's own noise, from what is within the languages; one document alone says nothing of it
    noise = (F.col("bits") - F.col("m")) * F.sqrt(F.col("text_bytes") * F.col("n") / (F.col("n") - 1))
    inside = sample.join(renamed, F.col("lang").eqNullSafe(F.col("l"))).where("n > 1").agg(F.percentile_approx(noise, [0.5, 0.8413], 100_000)).first()[0]
    sigma = max(inside[1] - inside[0], 1e-6) if inside else 1.0
    between = max(0.0, apart / sigma**2 - error)
    w = F.lit(between) / (F.lit(between) + F.col("v"))
    own = saved(own.select("lang", "n", (F.lit(mean) + w * (F.col("m") - mean)).alias("level"), (w * F.col("v")).alias("spread")))
    at = own.select(F.col("lang").alias("l"), "level", "spread")
    excess = saved(sample.join(at, F.col("lang").eqNullSafe(F.col("l"))).select("lang", excess_of(F.col("bits"), F.col("text_bytes"), F.col("level"), F.col("spread")).alias("excess")))
    total, high = excess.agg(F.count(F.lit(1)), F.percentile_approx("excess", quantile, 100_000)).first()
    # the standard error of a quantile of normal noise, from n documents
    normal = NormalDist()
    one = sigma * math.sqrt(quantile * (1 - quantile)) / normal.pdf(normal.inv_cdf(quantile))
    limit = lambda q, n: q + margin * one / F.sqrt(n)
    weight = 1 / (1 - quantile)
    quantiles = excess.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("excess", quantile, 100_000).alias("q"))
    pooled = limit(F.lit(high), F.lit(total))
    threshold = (F.col("n") * limit(F.col("q"), F.col("n")) + weight * pooled) / (F.col("n") + weight)
    out = saved(own.join(quantiles, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "n", "level", "spread", threshold.alias("threshold")))
    return out, (mean, between, sample.sparkSession.range(1).select(pooled).first()[0])


def excess_of(bits: Column, size: Column, level: Column, spread: Column) -> Column:
    """Cross-entropy above the level, in units of the noise of both."""
    return (bits - level) / F.sqrt(1 / size + spread)


def _judged(docs: DataFrame, trusted_ids: DataFrame, row_no: str, id_col: str, text_col: str, lang_col: str, quantile: float, margin: float, held_out: float) -> DataFrame | None:
    """(row_no, perplexity, excess, threshold, kept) of each row of docs; None if there is no trusted text."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= cluster.BROADCAST_IDS else ids
    narrow = docs.select(F.col(row_no).alias("row_no"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out_of_model = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(1000)) < int(held_out * 1000)
    counts = saved(gram_counts(narrow.join(ids, F.col("id") == F.col("trusted_id"), "left_semi").where(~out_of_model & (F.col("text") != "")), "text"))
    if not counts.limit(1).count():
        return None
    said = scores(narrow, kneser_ney(counts), "row_no")
    bits = F.when(F.col("text_bytes") > 0, -F.col("log_prob") / F.col("text_bytes"))
    rows = saved(narrow.select("row_no", "id", "lang").join(said, "row_no", "left").select("row_no", "id", "lang", F.coalesce("text_bytes", F.lit(0)).cast("long").alias("text_bytes"), bits.alias("bits")))
    sample = saved(rows.where(out_of_model & F.col("bits").isNotNull()).join(ids, F.col("id") == F.col("trusted_id"), "left_semi").select("lang", "bits", "text_bytes"))
    levels, others = levels_by_language(sample, quantile, margin)
    levels = levels.select(F.col("lang").alias("of_lang"), "level", "spread", "threshold")  # a row per language
    out = rows.join(levels, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    level, spread, threshold = (F.coalesce(F.col(c), F.lit(float(x))) for c, x in zip(("level", "spread", "threshold"), others))
    excess = excess_of(F.col("bits"), F.nullif(F.col("text_bytes"), F.lit(0)), level, spread)
    return out.select("row_no", F.exp("bits").alias("perplexity"), excess.alias("excess"), threshold.alias("threshold"), F.coalesce(excess <= threshold, F.lit(False)).alias("kept"))


OUTPUTS = ("perplexity", "excess", "threshold", "kept")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, margin: float = 3.0, held_out: float = 0.2, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those of keep) with perplexity (per byte), excess, threshold and kept; one row per input row.

    trusted_ids: one column of ids whose documents are trusted. A share held_out of them, chosen by a hash
    of the id, doesn't train the model but sets the thresholds. excess is the cross-entropy above the level
    of the language's held-out documents, times the root of the number of bytes, since short texts vary more,
    and less as far as few documents leave the level uncertain. threshold is the language's quantile of it and
    margin of the quantile's standard errors above. Every language (null is one) has its own level and threshold,
    from one held-out document on (see levels_by_language). One without any has the mean level of all
    languages, the differences between these as the level's error, and the pooled threshold; as the model
    doesn't know it either, most of its texts may be rejected. kept: excess is at most the threshold. Null and
    empty texts have a null perplexity and are not kept. Without trusted text there is no model, and every row
    is kept. Repeated rows are judged each for itself, null ids are never trusted, texts of any length are
    judged whole, and an empty table gives an empty one. Columns named like an output column are replaced.
    docs is read more than once and its rows are told apart by their place, so it should come from files.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    row_no = new_name(docs, "row_no")
    docs = docs.withColumn(row_no, F.monotonically_increasing_id())
    judged = _judged(docs, trusted_ids, row_no, id_col, text_col, lang_col, quantile, margin, held_out)
    if judged is None:
        null = F.lit(None).cast("double")
        return docs.select(*(docs[c] for c in carried), *(null.alias(c) for c in OUTPUTS[:3]), F.lit(True).alias("kept"))
    rows = docs.select(F.col(row_no).alias(new_name(docs, "judged_row")), *(docs[c] for c in carried))
    return rows.join(judged, rows[rows.columns[0]] == judged["row_no"]).select(*(rows[c] for c in carried), *(judged[c] for c in OUTPUTS))


def good_documents(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, margin: float = 3.0, held_out: float = 0.2) -> DataFrame:
    """The rows of docs that classify keeps, with their own columns. Texts don't shuffle where
    few enough rows are rejected (see cluster.without)."""
    row_no = new_name(docs, "row_no")
    rows = docs.withColumn(row_no, F.monotonically_increasing_id())
    judged = _judged(rows, trusted_ids, row_no, id_col, text_col, lang_col, quantile, margin, held_out)
    if judged is None:
        return docs
    return without(rows, row_no, judged.where("not kept").select("row_no")).select(*(rows[c] for c in docs.columns))
