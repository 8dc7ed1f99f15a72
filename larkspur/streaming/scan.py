"""Incremental scans and mail imports with Structured Streaming.

A scan is a stream of landed files, taken in bounded micro-batches; stopping and going on is the query's
checkpoint. Each batch writes postings first; the stream commits its offsets after that, so a lost
batch is read again and the keyed upsert makes it harmless.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import last_by_key
from ..sources.records import Record
from ..sources.tables import written
from ..sources.versions import VersionedTable


def landed_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], name: str | None = None) -> StreamingQuery:
    """Process what has landed since the last run, batch by batch, then end. stop() ends it earlier; a later run goes on."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def run_stoppable(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], progress: Record, steps: int = 0) -> dict:
    """Like run_available, and stops between batches where the record asks for it; returns the record then.

    The record counts batches, and its wish to stop is looked at before each one: a batch that isn't begun stays for the
    next run, which goes on from the checkpoint. A record that still asks to stop is cleared by the run that begins.
    """
    begun = progress.patch(running=True, stopRequested=False, stopped=False, completed=False, totalSteps=steps, startedAt=datetime.now(timezone.utc).isoformat(), finishedAt=None)
    stopped: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        if progress.get()["stopRequested"]:
            stopped.append(number)
            raise InterruptedError("the record asks to stop")
        write(batch, number)
        progress.patch(completedSteps=progress.get()["completedSteps"] + 1, nextStepIndex=number + 1, lastSavedAt=datetime.now(timezone.utc).isoformat())

    query = run_available(stream, checkpoint, step)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            progress.patch(running=False, finishedAt=datetime.now(timezone.utc).isoformat())
            raise
    return progress.patch(running=False, stopped=bool(stopped), completed=not stopped, finishedAt=datetime.now(timezone.utc).isoformat()) | {"startedAt": begun["startedAt"]}


def table_upsert(table: str, key: str, prepare: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, keep: int = 20) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges prepared rows into a versioned table of key buckets (see sources.versions).

    Only buckets that a batch touches are read and written, so a batch costs what it changes; choose buckets
    for the table's size. Of a batch's rows with one key the last counts, by ingest_seq or as they come. A
    batch that is written again starts from what was there before it. The last `keep` versions stay readable.
    """
    of_key = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = prepare(batch)
        seq = "ingest_seq" if "ingest_seq" in rows.columns else "place_in_batch_"
        rows = rows if seq == "ingest_seq" else rows.withColumn(seq, F.monotonically_increasing_id())
        rows = written(last_by_key(rows, F.col(key), seq).select([x for x in rows.columns if x != "place_in_batch_"]))
        touched = [r[0] for r in rows.select(of_key).distinct().collect()]  # at most `buckets`
        store = VersionedTable(spark, table)
        base = store.before(number)
        old = store.read(base, touched)
        store.add((rows if old is None else merge(old, rows)).withColumn("bucket", of_key), base, number)
        store.expire(keep)

    return write


def newest(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as its last version has it, None where there is none."""
    store = VersionedTable(spark, table)
    return store.read(store.current())


def new_mails(stream: DataFrame, id_col: str = "gmailMessageId", time_col: str | None = None, late: str = "14 days") -> DataFrame:
    """Each message once. With a time column the state is bounded by how late a copy may come."""
    if time_col is None:
        return stream.dropDuplicates([id_col])
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def progress(query: StreamingQuery) -> dict:
    """What a poller shows: batches so far, rows of the last one, whether it runs."""
    last = query.lastProgress
    return {"running": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}


def persist_import(jobs: DataFrame, jobs_path: str, state: DataFrame, state_path: str) -> None:
    """Postings first, then the state: if the postings fail, the mails stay unprocessed."""
    jobs.write.mode("overwrite").parquet(jobs_path)
    state.write.mode("overwrite").parquet(state_path)


def processed_tail(processed: DataFrame, new: DataFrame, id_col: str, time_col: str, keep: int) -> DataFrame:
    """Processed ids with their times, the newest `keep`."""
    both = processed.select(id_col, time_col).unionByName(new.select(id_col, time_col)).groupBy(id_col).agg(F.max(time_col).alias(time_col))
    return both.orderBy(F.desc(time_col), id_col).limit(keep)
