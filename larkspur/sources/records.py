"""Small records that a running job and its user both change, as JSON files: progress of a scan and the wish to stop it."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession

#: A scan that hasn't begun.
SCAN_PROGRESS = {
    "running": False, "stopRequested": False, "stopped": False, "completed": False, "nextStepIndex": 0, "completedSteps": 0, "totalSteps": 0,
    "currentQuery": "", "currentProvider": "", "lastSavedAt": None, "startedAt": None, "finishedAt": None,
}


class Record:
    """One JSON object at path, with defaults for what it lacks. A reader sees the old or the new one, never a part."""

    def __init__(self, spark: SparkSession, path: str, defaults: dict):
        self.path, self.defaults = path, dict(defaults)
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def get(self) -> dict:
        at = self._at(self.path)
        if not self.fs.exists(at):
            return dict(self.defaults)
        stream = self.fs.open(at)
        try:
            # a byte-order mark at the front is no part of the object
            return self.defaults | json.loads(bytes(stream.readAllBytes()).decode("utf-8-sig") or "{}")
        finally:
            stream.close()

    def patch(self, **changes) -> dict:
        """The record with these changes and updatedAt, stored."""
        now = self.get() | changes | {"updatedAt": datetime.now(timezone.utc).isoformat()}
        part = self._at(f"{self.path}.{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(now, ensure_ascii=False).encode()))
        out.close()
        at = self._at(self.path)
        if not self.fs.rename(part, at):  # file systems that don't replace
            self.fs.delete(at, False)
            self.fs.rename(part, at)
        return now


def scan_progress(spark: SparkSession, path: str) -> Record:
    return Record(spark, path, SCAN_PROGRESS)


def request_stop(progress: Record) -> dict:
    return progress.patch(stopRequested=True)
