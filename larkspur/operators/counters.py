"""Counts of a scan, taken in the passes that make its rows instead of by scans of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGES = ("raw", "normalized", "scored", "errors")


class ScanCounts:
    """Rows of each stage by provider. watch() marks the rows of a plan; their counts are there when an action has run over it.

    The providers are a known short list; rows of others count under `other`.
    """

    def __init__(self, providers: Sequence[str], other: str = "other"):
        self.providers, self.other = list(dict.fromkeys(providers)), other
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, stage: str, source: Column) -> DataFrame:
        """The same rows; counted under their source when an action reads them. A plan that several actions run counts once."""
        if stage not in STAGES:
            raise ValueError(f"no stage of a scan: {stage}")
        seen = Observation()
        known = [F.count_if(F.coalesce(source == p, F.lit(False))).alias(f"n{i}") for i, p in enumerate(self.providers)]
        self.seen.append((stage, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("all"), *known)

    def totals(self) -> dict[str, dict[str, int]]:
        """Counts by provider and stage; waits for actions that haven't run yet."""
        out = {p: dict.fromkeys(STAGES, 0) for p in [*self.providers, self.other]}
        for stage, seen in self.seen:
            found = seen.get
            known = [found[f"n{i}"] for i in range(len(self.providers))]
            for p, n in zip(self.providers, known):
                out[p][stage] += n
            out[self.other][stage] += found["all"] - sum(known)
        return {p: c for p, c in out.items() if any(c.values())}

    def rows(self, spark: SparkSession) -> DataFrame:
        """(source, raw, normalized, scored, errors), like provider_counts."""
        return spark.createDataFrame([(p, *(c[s] for s in STAGES)) for p, c in sorted(self.totals().items())], "source string, " + ", ".join(f"{s} long" for s in STAGES))
