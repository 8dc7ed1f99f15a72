"""Patterns as a search in linear time: it finds what the slow one finds, and the scan reads its long texts by it first."""

from pyspark.sql import functions as F

from larkspur.functions import vocabulary as V
from larkspur.functions.linear import wider
from larkspur.functions.text import matches, seen, squeezed, years_at_least
from larkspur.operators import enrich
from larkspur.schemas import JOBS

TEXTS = [
    None, "", "QA", "xqa qa", "Kqa", "qſa qaſ", "senior lead", "team\u000blead", "team lead", "position :\n", "לפני", "לפני\n", "x לפני", "פקיד", "פקידה א", "פקידות", "אפקיד", "5+ שנים", "ניסיון\nשל 5", "ניסיון של 12 שנות",
    "JobID=12", "MANUAL tester", "\U0001d52eqa", "#a", 'ע"י', "רצ", 'ר"צ', "customer\u0085service", "שירות  לקוחות", "experience 3", "a\r\nqa\r\n", "tel\taviv", "full stack", "qa automation", "ראש צוות",
]


def lists():
    found = {n: tuple(v) for n, v in vars(V).items() if isinstance(v, list) and v and all(isinstance(x, str) for x in v)}
    return found | {f"place {k}": tuple(p) for k, _, p in V.LOCATIONS} | {"clerk": (V.CLERK,), "qa": (V.LETTER_BOUND_QA,), "ahead": (r"a(?!b)\b", r"^x.$"), "outside": (r"[^\s\d]q", r"[^a-z]qa\W")}


def test_seen_is_what_matches_says(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    for name, patterns in lists().items():
        assert wider(patterns), name
    slow = df.select("i", *(matches(F.col("t"), *p).alias(f"m{k}") for k, p in enumerate(lists().values())))
    fast = df.select("i", *(seen(F.col("t"), *p).alias(f"m{k}") for k, p in enumerate(lists().values())))
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, fast.collect()))


def test_patterns_without_a_counterpart_are_read_as_before(spark):
    df = spark.createDataFrame([("abab",), ("ab",)], "t string")
    assert wider((r"(ab)\1",)) is None and [r[0] for r in df.select(seen(F.col("t"), r"(ab)\1")).collect()] == [True, False]


def test_long_texts_are_read_in_linear_time_first(spark):
    plan = enrich.finalize(spark.createDataFrame([], JOBS))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    df = spark.createDataFrame([("experience " + "x" * 48 + " 7",), ("experience " + "x" * 60 + " 7",)], "t string")
    assert [r[0] for r in df.select(years_at_least(F.col("t"), 4)).collect()] == [True, False]


def test_squeezed_runs(spark):
    odd = ["a  b", " a\tb ", "a \n b\n", "\t", "a b c", "a  b", "\n a", "a\x0b\x0cb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    assert [r[1] for r in sorted(df.select("i", squeezed(F.col("t"))).collect())] == [" ".join(t.split()) for t in odd]
