"""Operator 8, token-id output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are ranked by how often the corpus has them. A rank takes 1 to 4 bytes; two bits of a separate
control stream say how many, four ranks to a control byte, and decoding looks up the lengths of four
ranks at a time in a table. A file holds blocks of whole documents in ascending id order; the folder's
`ranks` table turns ranks back into ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import mapped_text, saved, shared_dir, ship

#: Bytes of each of four ranks, by control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
LENGTHS += 1
BLOCK_TOKENS = 1_000_000


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = np.asarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks that encode_ranks was given."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    raw = np.frombuffer(data, np.uint8)
    begin = np.cumsum(size) - size
    out = raw[begin].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        out[more] |= raw[begin[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with n_tokens and ids (little-endian, 16 bits wide where the vocabulary allows, else 32), end_id last."""

    def work():
        from .pretokens import encoder

        enc = encoder(tokenizer_path)
        wide = "<u2" if enc.table.size <= 1 << 16 else "<u4"
        step = np.dtype(wide).itemsize

        def fn(texts):
            sizes, ids = enc.encode(texts)
            total = sizes + 1
            flat = np.full(int(total.sum()), end_id, wide)
            body = np.ones(len(flat), bool)
            end = np.cumsum(total)
            body[end - 1] = False
            flat[body] = ids
            raw = flat.tobytes()
            return None, [total, [raw[step * (e - n) : step * e] for e, n in zip(end.tolist(), total.tolist())]]

        return fn

    return mapped_text(docs, text_col, "n_tokens long, ids binary", work, keep=keep)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens_per_file: int = 8_000_000) -> None:
    """Write the documents' ids (end_id behind each) under path: `blocks`, in ascending order of id, and `ranks`.

    Null and empty texts are an end id alone. Null ids come first; rows of one id follow each other in any
    order. An empty table gives files without rows. Texts are encoded once: the ids are kept in the shared
    folder, counted, sorted by range and written.
    """
    import public_tokenizers  # noqa: F401  the vocabulary has to be there on the driver, too
    from .pretokens import merge_table

    spark = docs.sparkSession
    ship(spark)
    wide = "<u2" if merge_table(tokenizer_path).size <= 1 << 16 else "<u4"
    kept = shared_dir(spark)
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    token_ids(doc, tokenizer_path, end_id, keep=["doc_id"]).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.schema("doc_id long, n_tokens long, ids binary").parquet(kept)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                part = np.bincount(np.frombuffer(x.as_buffer(), wide))
                if len(part) > len(total):
                    part, total = total, part.astype(np.int64)
                total[: len(part)] += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    ranks = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))  # as many rows as the vocabulary has
    ranks = ranks.select("id", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    by_id = {r["id"]: r["rank"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    rank_of = np.zeros(max(by_id, default=0) + 1, np.uint32)
    rank_of[list(by_id)] = list(by_id.values())
    tokens = ids.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-tokens // tokens_per_file))

    def blocks(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        names: list[int | None] = []
        part, number, total = 0, 0, 0

        def block():
            control, data = encode_ranks(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "block", "n_tokens", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for p, name, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                part = p
                held.append(rank_of[np.frombuffer(x.as_buffer(), wide)])
                names.append(name)
                total += len(held[-1])
                if total >= BLOCK_TOKENS:
                    yield block()
                    held, names, number, total = [], [], number + 1, 0
        if held:
            yield block()

    # range partitions ascend by id; the row number keeps a frequent id from filling one of them
    order = [F.col("doc_id").asc_nulls_first(), F.col("no")]
    ordered = ids.withColumn("no", F.monotonically_increasing_id()).repartitionByRange(int(files), *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(blocks, "part int, block long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what write_token_files wrote, decoded; start counts the ids of all documents before.

    ids: little-endian unsigned 32-bit.
    """
    ship(spark)
    by_rank = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}  # at most the vocabulary
    id_of = np.zeros(len(by_rank), "<u4")
    id_of[list(by_rank)] = list(by_rank.values())
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_tokens")
    files = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # a row per file
    files = files.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start")).join(files, "part")
    starts = starts.select("part", "block", (F.col("file_start") + F.col("block_start")).alias("begin"))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = id_of[decode_ranks(row["control"], row["data"], row["n_tokens"])]
                raw, end = ids.tobytes(), np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(lengths), pa.int32()), pa.array([row["block"]] * len(lengths), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(end - lengths), pa.array(lengths), pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), lengths.tolist())], pa.binary())], names=["part", "block", "doc_id", "inside", "n_tokens", "ids"])

    # blocks are decoded where they are read; only their places are joined
    docs = blocks.mapInArrow(decode, "part int, block long, doc_id long, inside long, n_tokens long, ids binary")
    return docs.join(F.broadcast(starts) if starts.count() <= 1_000_000 else starts, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids")
