"""The toxicity grammar on clauses, its composed table against single steps, learning on made labels, odd rows."""

import os
import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")
from larkspur.llm import queries, toxicity  # noqa: E402

DIR = os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.01")
SEEDS = toxicity.Lexicon({w + "$": toxicity.SEED for w in toxicity.INSULTS})


def weights(text):
    return [(toxicity.KINDS[k], round(w / toxicity.SEED, 3)) for _, _, k, w in toxicity.matches_of(text, SEEDS)[0]]


def test_clauses():
    assert weights("What an idiot.") == [("insult", 1.0)]
    assert weights("You are an idiot.") == [("aimed insult", 1.5)]
    assert weights("You are not an idiot.") == [("aimed insult", 0.375)]
    assert weights("Idiots, they") == [("insult", 1.0), ("aimed insult", 0.5)]
    assert weights("He said you are an idiot. What an idiot!") == [("aimed insult", 0.6), ("insult", 1.0)]
    assert weights('Anna said "an idiot. A moron" and left. A moron.') == [("insult", 0.4), ("insult", 0.4), ("insult", 1.0)]
    assert weights("It took a week to kill the process.") == []
    third = round(2 / toxicity.SEED, 3)
    assert weights("We will kill it.") == [("threat", third)] and weights("Kill them") == [("threat", third)]
    assert weights("I will not kill it.") == [("threat", round(0.5 / toxicity.SEED, 3))]
    assert weights("you the are of the stupid") == [("insult", 1.0)], "the target is out of reach"
    assert weights("IDIOT ist idiotisch; du Trottel") == [("insult", 1.0), ("aimed insult", 1.5)]


def stepped(symbols):
    """Matches as the rules say, looking back over the whole sequence at each place."""
    out = []
    for i, s in enumerate(symbols):
        def near(symbol, reach, blocks=(toxicity.STOP,)):
            left = reach
            for t in reversed(symbols[:i]):
                if t in blocks and t != symbol:
                    return False
                if t == symbol:
                    return True
                left -= t != toxicity.QUOTE
                if left <= 0:
                    return False
            return False

        aim, intent, no = (near(x, toxicity.REACH[n]) for x, n in ((toxicity.TARGET, "target"), (toxicity.INTENT, "intent"), (toxicity.NEGATION, "negation")))
        waits = (toxicity.STOP, toxicity.TARGET)
        insult, threat = near(toxicity.INSULT, toxicity.REACH["insult"], waits), near(toxicity.THREAT, toxicity.REACH["threat"], waits)
        verb = quoted = False
        said = False
        for t in symbols[: i + 1]:
            said = quoted if t == toxicity.REPORT else False if t == toxicity.STOP and not quoted else verb or quoted
            if t == toxicity.QUOTE:
                verb, quoted = verb and quoted, not quoted and verb
            elif t == toxicity.REPORT:
                verb = True
            elif t == toxicity.STOP and not quoted:
                verb = False
        f = (toxicity.NEGATED if no else 1) * (toxicity.REPORTED if said else 1)
        if s == toxicity.INSULT:
            out.append((i, 1 if aim else 0, f * (toxicity.AIMED if aim else 1)))
        elif s == toxicity.THREAT and (aim or intent):
            out.append((i, 2, f * toxicity.THREATENED * (toxicity.AIMED if aim and intent else 1)))
        elif s == toxicity.TARGET and threat:
            out.append((i, 2, f * toxicity.THREATENED))
        elif s == toxicity.TARGET and insult and not aim:
            out.append((i, 1, f * (toxicity.AIMED - 1)))
    return out


def test_composed_table_steps_like_its_parts():
    following, matches = toxicity.grammar()
    r = random.Random(1)
    for _ in range(1500):
        symbols = [r.choice([0, 0, 0, *range(9)]) for _ in range(r.randrange(14))]
        state, got = 0, []
        for i, s in enumerate(symbols):
            if matches[state][s]:
                got.append((i, matches[state][s][0], matches[state][s][1]))
            state = following[state][s]
        assert got == stepped(symbols), symbols


def test_long_texts_in_pieces(monkeypatch):
    text = "You idiot, they said. " * 50 + "x" * 80 + " what a moron"
    whole = toxicity.matches_of(text, SEEDS)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert toxicity.matches_of(text, SEEDS) == whole and whole[1] == 204
    for s, e, _, _ in whole[0]:
        assert text[s:e].split()[0].strip(",") in ("idiot", "moron")


def test_learns_words_and_prefixes(spark):
    r = random.Random(5)
    plain = lambda: [r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + r.choice(["", "an", "er"]) for _ in range(60)]
    docs, labels = [], []
    for i in range(240):
        words, bad = plain(), i % 4 == 0
        if bad:
            words[5:50:9] = ["zork" + r.choice(["", "an", "ich", "ette", "ulo"]) for _ in range(5)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1), (7, None), (4, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, y.where("doc_id % 3 > 0 or doc_id is null"))
    assert "zork" in model.insults and not any(p.startswith(("alp", "bet", "gam")) for p in model.insults)
    got = toxicity.score_toxicity(d, model).collect()
    assert all(g.predicted == int(g.doc_id % 4 == 0) for g in got)
    none = toxicity.fit_toxicity(d, y.where("doc_id < 0"))
    assert none.factors == toxicity.ToxicityModel.factors and set(none.insults) == {w + "$" for w in toxicity.INSULTS}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "you idiot", "c"), (2, "you idiot", "d"), (3, " \t\n.", "e"), (4, "word " * 300_000, "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.text_id: r for r in toxicity.score_toxicity(d.withColumn("text_id", d.score), toxicity.ToxicityModel({"idiot": 3.0})).collect()}
    assert got["a"].score == got["b"].score == got["e"].score and got["a"].matches == [] and got["a"].n_words == 0
    assert got["c"].score == got["d"].score > got["a"].score and [m.kind for m in got["d"].matches] == ["aimed insult"]
    assert got["f"].n_words == 300_000
    assert toxicity.score_toxicity(d.where("doc_id > 99"), toxicity.ToxicityModel()).count() == 0
    held = {r.doc_id: r.h for r in d.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert held == {None: False} | {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 4)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
def test_query_on_held_out_rows(spark):
    got = queries.op11_toxicity(spark, DIR)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == queries.table(spark, DIR, "documents").count()
    rows = got.where("held_out").join(queries.table(spark, DIR, "labels"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
