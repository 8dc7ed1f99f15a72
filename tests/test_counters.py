"""Counts taken while rows are made, stopping and resuming by a record, marks at the front of files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.counters import ScanCounts
from larkspur.sources.records import SCAN_PROGRESS, Record, request_stop, scan_progress
from larkspur.sources.tables import written
from larkspur.streaming import scan


def test_counts_in_the_pass_that_writes(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").when(F.col("id") < 50, "zzz").alias("source"), "id")
    counts = ScanCounts(["a", "b"])
    seen = counts.watch(rows, "raw", F.col("source"))
    kept = counts.watch(seen.where("id < 30"), "normalized", F.col("source"))
    assert written(kept).count() == 30
    assert counts.totals() == {"a": {"raw": 34, "normalized": 10, "scored": 0, "errors": 0}, "b": {"raw": 33, "normalized": 10, "scored": 0, "errors": 0}, "other": {"raw": 33, "normalized": 10, "scored": 0, "errors": 0}}
    assert [tuple(r) for r in counts.rows(spark).orderBy("source").collect()][0] == ("a", 34, 10, 0, 0)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 2 and "Aggregate" not in plan
    with pytest.raises(ValueError):
        counts.watch(rows, "lost", F.col("source"))


def test_a_record_stops_a_scan_and_the_next_run_goes_on(spark, tmp_path):
    for n in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(f'{{"k": {n}}}')
    progress = scan_progress(spark, f"file://{tmp_path}/progress.json")
    assert progress.get() == SCAN_PROGRESS
    got = []

    def write(batch, number):
        got.extend(r.k for r in batch.collect())
        if len(got) == 2:
            request_stop(progress)

    stream = lambda: scan.landed_stream(spark, str(tmp_path / "in"), T.StructType.fromDDL("k int"))
    first = scan.run_stoppable(stream(), str(tmp_path / "ck"), write, progress, steps=4)
    assert len(got) == 2 and first["stopped"] and not first["completed"] and not first["running"] and first["completedSteps"] == 2
    second = scan.run_stoppable(stream(), str(tmp_path / "ck"), write, progress, steps=4)
    assert sorted(got) == [0, 1, 2, 3] and second["completed"] and second["completedSteps"] == 4 and not second["stopRequested"]
    (tmp_path / "in" / "9.json").write_text('{"k": 9}')

    def fails(batch, number):
        raise RuntimeError("broken")

    with pytest.raises(Exception, match="broken"):
        scan.run_stoppable(stream(), str(tmp_path / "ck"), fails, progress)
    assert not progress.get()["running"]


def test_records_with_a_mark_and_without_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_bytes("﻿{\"a\": 1}".encode())
    record = Record(spark, f"file://{tmp_path}/r.json", {"a": 0, "b": 2})
    assert record.get() == {"a": 1, "b": 2}
    after = record.patch(b=3)
    assert record.get() == after and after["a"] == 1 and "updatedAt" in after
    (tmp_path / "e.json").write_bytes(b"")
    assert Record(spark, f"file://{tmp_path}/e.json", {"x": 1}).get() == {"x": 1}
