"""One test for each loose rule of the job records that Spark's functions don't follow by themselves."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text, urls
from larkspur.functions.rules import FirstMatch, RoleProfile, usable_pattern


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]) if all(v is not None for v in values.values()) else spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("v")).first()["v"]


def test_join_drops_null_and_empty(spark):
    assert one(spark, text.join_truthy(" ", F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "a b"


def test_or_else_falls_through_empty(spark):
    assert one(spark, text.or_else(F.lit(""), F.lit("b"))) == "b"


@pytest.mark.parametrize(("value", "pattern", "hit"), [("בqa", r"\bqa\b", True), ("aqa", r"\bqa\b", False), ("Salesforce", r"\bsales\b(?!\s*force)", False), ("sales  x", r"\bsales\b(?!\s*force)", True), ("strong", "str", True), (None, "x", False)])
def test_word_borders_are_ascii(spark, value, pattern, hit):
    assert one(spark, text.matches(F.col("s"), pattern), s=value) is hit


def test_clerk_is_no_part_of_role(spark):
    from larkspur.functions.vocabulary import CLERK

    assert one(spark, text.matches(F.col("s"), CLERK), s="תפקיד") is False
    assert one(spark, text.matches(F.col("s"), CLERK), s="פקידה טובה") is True


def test_white_space_includes_no_break_space(spark):
    assert one(spark, text.squeezed(F.col("s")), s="a  b ") == "a b"


def test_halves_round_up(spark):
    assert one(spark, text.rounded(F.lit(-2.5))) == -2
    assert one(spark, text.rounded(F.lit(2.5))) == 3


def test_tail_of_short_array(spark):
    assert one(spark, text.tail(F.array(F.lit(1), F.lit(2)), 3)) == [1, 2]
    assert one(spark, text.tail(F.array(F.lit(1), F.lit(2)), 1)) == [2]


def test_slug_id(spark):
    assert one(spark, text.slug_id(F.lit("QA Engineer"), F.lit(""), F.lit("חיפה"), F.lit("https://x.co/a?b=1"))) == "qa-engineer-חיפה-x-co-a-b-1"


def test_base64url_round_trip(spark):
    s = "מפתח|" + "x" * 100 + "??>>"
    assert one(spark, text.unbase64url(text.base64url(F.col("s"))), s=s) == s
    assert "=" not in one(spark, text.base64url(F.col("s")), s=s)


def test_years(spark):
    assert one(spark, text.years_at_least(F.col("s"), 4), s="דרוש ניסיון של 5 שנים") is True
    assert one(spark, text.years_at_least(F.col("s"), 4), s="3 years") is False


def test_tokens_first_then_distinct(spark):
    assert one(spark, text.tokens(F.col("s"), 3), s="the alpha alpha beta gamma") == ["alpha", "beta"]


def test_keywords(spark):
    assert one(spark, text.keyword_hits(F.col("s"), ["QA", "sql", "בדיקות"]), s="SQL ו בדיקות qa") == ["sql", "בדיקות"]


def test_broken_pattern_is_taken_literally(spark):
    assert usable_pattern("[") == r"\["
    assert usable_pattern(" ") is None
    assert one(spark, RoleProfile("p", "p", ["["]).fits(F.col("s")), s="a [ b") is True


def test_first_match_goes_by_table_order(spark):
    assert one(spark, FirstMatch([("x", ["b"]), ("y", ["a"])]).value(F.col("s")), s="a b") == "x"


def test_provider_ids(spark):
    assert one(spark, urls.provider_key(F.col("u"), ["alljobs", "jobmaster"]), u="https://a/?x=1&JobID=77") == "alljobs:77"
    assert one(spark, urls.provider_id(F.col("u"), "drushim"), u="https://www.drushim.co.il/job/55/x") == "55"
    assert one(spark, urls.host(F.col("u")), u="not a url") == ""


def test_strip_html(spark):
    assert one(spark, urls.strip_html(F.col("h")), h="<style>p{}</style><p>a&nbsp;<b>b</b></p><script>x</script>&amp;") == "a b &"


def plain(patterns):
    return "(?i)" + "|".join(f"(?:{text.word_borders(p)})" for p in patterns)


def test_dealt_alternatives_find_what_plain_ones_do(spark):
    """All pattern lists of the vocabulary, and awkward ones, over texts made of their own pieces."""
    import random
    import re

    from larkspur.functions import vocabulary as V
    from larkspur.functions.starts import alternatives

    awkward = [["a|", "b"], ["^$", "x"], ["(?i)a|B"], [r"(a)\1|b"], ["[a|b]c|d"], ["[]|]x|y"], [r"\|a|b"], ["(?:|a)b"], ["[^a]b|c"], [r"\d+ x|\s y"], ["x*y|z?"], ["(?:qa|בדיקה)s|K|ſ"], [r"\bqa\b|\.net"], ["é|ש"], ["a{0}b|c"], ["(?=x)x1|(?<!q)w"], [r"\p{L}1|\w2"]]
    lists = [v for v in vars(V).values() if isinstance(v, (list, tuple)) and v and all(isinstance(x, str) for x in v)]
    rng = random.Random(5)
    pieces = [re.sub(r"\\s[*+]?|\\b|[\\^$?*+()|\[\]{}]", rng.choice(["", " "]), a) for v in lists + awkward for p in v for a in alternatives(p)]
    pieces += ["", " ", "\n", "é", "É", "ſ", "K", "K", "a1", "אב", "B", "12 X", "]x", "a|bc", "b", "1", "_"]
    change = [str.lower, str.upper, str.title, lambda x: x[1:], lambda x: x[:-1], lambda x: f"x{x}", lambda x: f"ש{x}"]
    texts = [rng.choice(["", " ", "\n", ", "]).join(rng.choice(change)(rng.choice(pieces)) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in texts], "s string")
    for at in range(0, len(lists + awkward), 20):
        both = [(text.matches(F.col("s"), *v), F.rlike("s", F.lit(plain(v)))) for v in (awkward + lists)[at : at + 20]]
        counts = rows.agg(*(F.count_if(a != b).alias(f"c{i}") for i, (a, b) in enumerate(both)), *(F.count_if(b).alias(f"n{i}") for i, (_, b) in enumerate(both))).first()
        assert [counts[f"c{i}"] for i in range(len(both))] == [0] * len(both)
        assert sum(counts[f"n{i}"] > 0 for i in range(len(both))) > len(both) * 0.8


def test_alternatives_are_tried_where_they_can_begin():
    assert text.any_of(("tester|qa", "מבדק")).startswith("(?=[QTqtמ])")
    assert text.any_of(("[^a-z]qa|tester",)).startswith("(?i:(?:[^a-z]qa))|(?=[Tt])")
