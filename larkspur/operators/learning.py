"""Learning from feedback: how earlier decisions on similar postings move a score.

The last 400 feedback rows, a bounded number, become codes and 0/1 matrices that each task gets, and Arrow batches of
postings are compared with all of them at once; points are added in log order, so sums of fractions come out
alike every time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import clamped, held, normalized, rounded, seen, text_of, tokens, truthy

LAST = 400
_TEXT = ("title", "company", "location", "locationKey", "description", "source", "via", "sourceQuery", "roleFamily", "roleType", "roleProfileName")
_TITLE = ("title", "sourceQuery", "roleFamily", "roleType", "roleProfileName")


def _fields(rows: DataFrame) -> dict[str, Column]:
    has = lambda n: F.col(n) if n in rows.columns else F.lit("")
    plain = {n: normalized(has(n)) for n in ("company", "location", "locationKey", "roleType", "roleProfileId")}
    source = F.coalesce(F.nullif(has("source"), F.lit("")), has("via"), F.lit(""))
    return plain | {"source": normalized(source), "words": tokens(text_of(*(has(n) for n in _TEXT))), "title_words": tokens(text_of(*(has(n) for n in _TITLE)))}


def feedback_tail(feedback: DataFrame, last: int = LAST, order: tuple[str, ...] = ("createdAt", "id")) -> DataFrame:
    """One row with `log`: the last rows of the feedback in log order, with all that a comparison needs."""
    recent = feedback.orderBy(*(F.desc(o) for o in order)).limit(last)
    reason = F.when(F.col("rejectionReason").isin(list(V.REJECTION_REASONS)), F.col("rejectionReason")) if "rejectionReason" in feedback.columns else F.lit(None).cast("string")
    weight = F.coalesce(F.create_map(*(x for k, v in V.ACTION_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("action")], F.lit(0.0))
    item = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col("jobId").alias("job_id"), reason.alias("reason"), weight.alias("weight"), *(v.alias(k) for k, v in _fields(feedback).items()))
    return recent.agg(F.array_sort(F.collect_list(item)).alias("log"))


class _Log:
    """The log's rows as columns of codes and 0/1 matrices, so that a batch of postings meets all of them at once."""

    SAME = ("company", "location", "locationKey", "roleType", "roleProfileId", "source")
    LIKENESS = (("company", 0.5), ("locationKey", 0.45), ("roleType", 0.55), ("roleProfileId", 0.65), ("source", 0.25))
    #: Postings that are compared at a time.
    STEP = 500

    def __init__(self, log: list[dict]):
        self.n = len(log)
        self.ids = self._codes([x["job_id"] for x in log])
        self.same = {f: self._codes([x[f] or None for x in log]) for f in self.SAME}
        self.reasons = list(V.REJECTION_REASONS)
        self.reason = np.array([self.reasons.index(x["reason"]) if x["reason"] else -1 for x in log], int)
        self.penalty = np.array([float(V.REJECTION_REASONS[x["reason"]][1]) if x["reason"] else 0.0 for x in log])
        self.weight = np.array([x["weight"] for x in log], float)
        self.words = {f: self._matrix([x[f] for x in log]) for f in ("words", "title_words")}

    @staticmethod
    def _codes(values: list) -> tuple[dict, np.ndarray]:
        known: dict = {}
        return known, np.array([-1 if v is None else known.setdefault(v, len(known)) for v in values], int)

    @staticmethod
    def _matrix(rows: list[list[str]]) -> tuple[dict, np.ndarray]:
        known: dict = {}
        at = [(known.setdefault(w, len(known)), i) for i, words in enumerate(rows) for w in words]
        out = np.zeros((len(known), len(rows)), np.float32)
        if at:
            out[tuple(np.array(at).T)] = 1
        return known, out

    def _equal(self, field: str, values: list) -> np.ndarray:
        """(postings, log): both there and equal."""
        known, codes = self.ids if field == "id" else self.same[field]
        mine = np.array([known.get(v, -2) if v is not None and v != "" or field == "id" else -2 for v in values], int)
        return mine[:, None] == codes

    def _shared(self, field: str, rows: list) -> np.ndarray:
        """(postings, log): how many words both have."""
        known, theirs = self.words[field]
        mine = np.zeros((len(rows), len(known)), np.float32)
        for i, words in enumerate(rows):
            mine[i, [known[w] for w in words if w in known]] = 1
        return mine @ theirs

    def effects(self, j: dict[str, list]) -> tuple[np.ndarray, list[list[str]]]:
        """Sum of the points of each posting in log order, and its distinct warnings in that order."""
        n = len(j["id"])
        own = self._equal("id", j["id"])
        own |= np.array([v is None for v in j["id"]], bool)[:, None] & (self.ids[1] < 0)
        same = {f: self._equal(f, j[f]) for f in self.SAME}
        place = np.array([bool(x) and x not in V.GENERIC_PLACES for x in j["location"]], bool)[:, None]
        hit = np.zeros((n, len(self.reasons) + 1), bool)  # the last column stands for no reason
        for i, told in enumerate(j["hit"]):
            hit[i, [self.reasons.index(x) for x in told]] = True
        by_text = hit[:, self.reason]
        by_place = (self.reason == self.reasons.index("location")) & (same["locationKey"] | same["location"]) & place
        by_role = (self.reason == self.reasons.index("wrong_role")) & ((self._shared("title_words", j["title_words"]) >= 2) | same["roleType"])
        fired = by_text | by_place | by_role
        likeness = np.zeros((n, self.n))
        for f, part in self.LIKENESS:
            likeness += np.where(same[f], part, 0.0)
        overlap = self._shared("words", j["words"]).astype(float)
        local = np.minimum(np.abs(self.weight), overlap * 1.4) + np.where(same["location"] & place, 2.0, 0.0) + np.where(same["source"], 1.0, 0.0)
        similar = self.weight * np.minimum(1.2, likeness) + np.where((overlap >= 2) & (self.weight != 0), np.sign(self.weight) * local, 0.0)
        points = np.where(own, 0.0, np.where(fired, self.penalty, similar))
        total = np.cumsum(points, axis=1)[:, -1] if self.n else np.zeros(n)
        fired &= ~own
        warnings: list[list[str]] = []
        for i in range(n):
            at = np.flatnonzero(fired[i])
            told = (self._warning(self.reason[k], by_text[i, k], by_place[i, k], j["place"][i]) for k in at)
            warnings.append(list(dict.fromkeys(w for w in told if w is not None)))
        return total, warnings

    def _warning(self, reason: int, by_text: bool, by_place: bool, place: str | None) -> str | None:
        if by_text:
            return f"למידה: בעבר פסלת משרות עם מאפיין דומה — {V.REJECTION_REASONS[self.reasons[reason]][0]}."
        if by_place:
            return None if place is None else f"למידה: בעבר פסלת מיקום דומה ({place})."
        return "למידה: בעבר פסלת תפקיד דומה."


def learning_columns(jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """jobs with learning_adjustment (-32..22), learning_reasons (at most 3) and learning_warnings (at most 6).

    The last LAST feedback rows, a bounded number, are read by the driver and go to the tasks; a batch of postings meets them
    by products of 0/1 matrices for shared words and by codes for equal fields. Postings don't shuffle. An empty log gives 0.
    """
    row = feedback_tail(feedback).first()
    log = _Log([x.asDict() for x in (row.log if row and row.log else [])])
    if not log.n:  # nothing to compare with
        none = F.array().cast("array<string>")
        return jobs.withColumns({"learning_adjustment": F.lit(0.0), "learning_reasons": none, "learning_warnings": none})
    columns, jobs = jobs.columns, held(jobs, learned_text_=text_of(*(F.col(n) for n in _TEXT if n in jobs.columns)))
    text = F.col("learned_text_")
    hit = {k: seen(text, *p) for k, (_, _, p) in V.REJECTION_REASONS.items() if p}
    hit["customer_service"] = hit["customer_service"] & (~seen(text, *V.SUPPORT_EVIDENCE) | seen(text, *V.SERVICE_EVIDENCE))
    fields = _fields(jobs) | {"id": F.col("id").cast("string"), "place": F.col("location").cast("string"), "hit": F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in hit.items())))}
    names = list(fields)

    def meet(*columns: pd.Series) -> pd.DataFrame:
        parts = [(np.zeros(0), [])]
        for k in range(0, len(columns[0]), log.STEP):
            parts.append(log.effects({n: x.iloc[k : k + log.STEP].tolist() for n, x in zip(names, columns)}))
        return pd.DataFrame({"total": np.concatenate([p[0] for p in parts]), "told": [w for p in parts for w in p[1]]})

    met = F.pandas_udf(meet, "total double, told array<string>")
    rows = jobs.select(*columns, met(*fields.values()).alias("met_"))
    rows = rows.withColumn("learning_adjustment", clamped(rounded(F.col("met_.total")), -32, 22).cast("double"))
    whole = F.col("learning_adjustment").cast("int").cast("string")
    up = F.when(F.col("learning_adjustment") >= 4, F.concat(F.lit("למידה: משרות דומות נשמרו או סומנו כהוגשו בעבר (+"), whole, F.lit(").")))
    down = F.when(F.col("learning_adjustment") <= -4, F.concat(F.lit("למידה: משרות דומות נדחו בעבר ("), whole, F.lit(").")))
    return rows.withColumns({
        "learning_reasons": F.array_compact(F.array(up)),
        "learning_warnings": F.slice(F.array_distinct(F.array_compact(F.concat(F.col("met_.told"), F.array(down)))), 1, 6),
    }).drop("met_")


def feedback_rows(jobs: DataFrame, action: str, at: Column, reason: str | None = None) -> DataFrame:
    """Snapshots of postings for the feedback log. An unknown action is an error; an unknown reason counts as none."""
    if action not in V.ACTION_WEIGHTS:
        raise ValueError(f"Unsupported feedback action: {action}")
    known = reason if reason in V.REJECTION_REASONS else None
    has = lambda n: F.coalesce(F.col(n), F.lit("")) if n in jobs.columns else F.lit("")
    source = F.coalesce(F.nullif(has("source"), F.lit("")), has("via"))
    rows = jobs.where(truthy(F.col("id")))
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("id"), F.lit(action), at.cast("string")), 256).alias("id"), F.col("id").alias("jobId"), F.lit(action).alias("action"), F.lit(known).cast("string").alias("rejectionReason"),
        F.lit(V.REJECTION_REASONS[known][0] if known else None).cast("string").alias("rejectionReasonLabel"), *(has(n).alias(n) for n in ("title", "company", "location", "locationKey")), source.alias("source"),
        *(has(n).alias(n) for n in ("sourceQuery", "roleFamily", "roleType", "roleProfileId", "roleProfileName")), (F.col("fitScore") if "fitScore" in jobs.columns else F.lit(None)).cast("int").alias("fitScore"),
        F.substring(has("description"), 1, 900).alias("description"), has("reviewKey").alias("reviewKey"), F.coalesce(F.col("fromManualReview"), F.lit(False)).alias("fromManualReview") if "fromManualReview" in jobs.columns else F.lit(False).alias("fromManualReview"), at.alias("createdAt"))
