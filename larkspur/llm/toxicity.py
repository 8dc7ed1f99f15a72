"""Operator 11, toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexical transducer (insult, threat, target, negation, intent, reporting verb), whose
insults are weighted prefixes learned from labels. Five small transducers each follow one thing: whether a target
stands near, whether the speaker announces something, whether a negation is in force, whether speech is reported,
and which insult or threat still waits for its target. Their product is one table, run over a text from left to
right; it puts out clause matches with weights. A document's score comes from the weights of its matches, so an
isolated threat verb counts for nothing, and a negated or reported insult for little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import mapped_text, saved, ship, slices

# Symbols of the lexical transducer.
OTHER, INSULT, THREAT, TARGET, NEGATION, INTENT, REPORT, QUOTE, STOP = range(9)

# Closed classes of words in English, German, French and Spanish, and a few insults to begin with.
TARGETS = """you your yours yourself you're youre u ur they them their he him she her these those
du dich dir dein deine ihr euch euer sie tu te toi ton ta vous votre vos ils elles usted ustedes vosotros tus ellos ellas""".split()
NEGATIONS = """not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't ain't cannot can't
nicht kein keine keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna""".split()
INTENTS = """will i'll we'll gonna going shall must should want hope
werde werden wird soll muss vais allons va vont doit voy vamos va van debe quiero""".split()
REPORTS = """said says say told called calls wrote writes quoted reported claimed alleged according
sagte sagt nannte schrieb zitierte behauptete dit disait appelé écrit cité dijo dice llamó escribió citó""".split()
THREATS = """kill hurt destroy murder beat stab shoot burn hang punch smash
töten umbringen schlagen erschießen tuer frapper détruire brûler matar golpear destruir quemar""".split()
INSULTS = """idiot idiots idiotic moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns imbecile dumb
dumm dummkopf abschaum widerlich erbärmlich trottel stupide imbécile minable ordure crétin idiota estúpido estúpida imbécil basura asqueroso""".split()

# How many words a target, an announcement or a negation reaches, and a pending insult waits for its target.
REACH = {"target": 4, "intent": 4, "negation": 3, "insult": 2, "threat": 3}
# What a match counts by what holds at it.
AIMED, NEGATED, REPORTED, THREATENED = 1.5, 0.25, 0.4, 2.0

#: Kinds of matches, in the order of their numbers.
KINDS = ["insult", "aimed insult", "threat"]

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;|\n]|[\"“”«»„]")


@dataclass(frozen=True)
class Fst:
    """A transducer over symbols: step gives (next state, what it puts out); states are found from start."""

    start: tuple
    step: object


def _near(symbol: int, reach: int, renew=(STOP,)) -> Fst:
    """Puts out whether symbol stands among the reach words before."""

    def step(state, s):
        left = state[0]
        after = reach if s == symbol else 0 if s in renew else left if s == QUOTE else max(left - 1, 0)
        return (after,), left > 0

    return Fst((0,), step)


def _reported() -> Fst:
    """Puts out whether speech is reported: after a reporting verb to the clause's end, and through a quotation that it opens."""

    def step(state, s):
        verb, quoted = state
        if s == QUOTE:
            return (verb and quoted, not quoted and verb), verb or quoted
        if s == REPORT:
            return (True, quoted), quoted
        if s == STOP and not quoted:
            return (False, False), False
        return state, verb or quoted

    return Fst((False, False), step)


def _waiting(symbol: int, reach: int) -> Fst:
    """Puts out whether symbol stands among the reach words before and has not met its target."""

    def step(state, s):
        left = state[0]
        after = reach if s == symbol else 0 if s in (STOP, TARGET) else left if s == QUOTE else max(left - 1, 0)
        return (after,), left > 0

    return Fst((0,), step)


@lru_cache(maxsize=1)
def grammar() -> tuple[list[list[int]], list[list[tuple | None]]]:
    """(next state, match) of the composed transducers by state and symbol.

    A match is (kind, factor, whether the waiting word's weight counts instead of this one's).
    """
    parts = [
        _near(TARGET, REACH["target"]),
        _near(INTENT, REACH["intent"]),
        _near(NEGATION, REACH["negation"]),
        _reported(),
        _waiting(INSULT, REACH["insult"]),
        _waiting(THREAT, REACH["threat"]),
    ]
    numbers, queue = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)]
    following: list[list[int]] = []
    matches: list[list[tuple | None]] = []
    for state in queue:
        row, out = [], []
        for s in range(STOP + 1):
            stepped = [p.step(at, s) for p, at in zip(parts, state)]
            aim, intent, negated, reported, insult, threat = (o for _, o in stepped)
            factor = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            match = None
            if s == INSULT:
                match = (1, AIMED * factor, False) if aim else (0, factor, False)
            elif s == THREAT and (aim or intent):
                match = (2, THREATENED * factor * (AIMED if aim and intent else 1.0), False)
            elif s == TARGET and threat:
                match = (2, THREATENED * factor, True)
            elif s == TARGET and insult and not aim:
                match = (1, (AIMED - 1) * factor, True)
            after = tuple(n for n, _ in stepped)
            if after not in numbers:
                numbers[after] = len(queue)
                queue.append(after)
            row.append(numbers[after])
            out.append(match)
        following.append(row)
        matches.append(out)
    return following, matches


#: Shortest and longest prefixes of words that may be insults.
PREFIXES = range(3, 11)


class Lexicon(dict):
    """Token to (symbol, weight), found once per distinct token; insults are weighted prefixes, the longest counts."""

    def __init__(self, insults: dict[str, float], most: int = 200_000):
        super().__init__()
        self.insults, self.most = insults, most
        self.closed = {w: s for words, s in ((REPORTS, REPORT), (INTENTS, INTENT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)) for w in words}

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        word = token.lower().replace("’", "'")
        if token in ".!?;|\n":
            found = (STOP, 0.0)
        elif not word[0].isalpha():
            found = (QUOTE, 0.0)
        elif word in self.closed:
            found = (self.closed[word], 1.0)
        else:
            weight = next((w for p in prefixes(word) if (w := self.insults.get(p)) is not None), 0.0)
            found = (INSULT, weight) if weight > 0 else (OTHER, 0.0)
        self[token] = found
        return found


def prefixes(word: str) -> list[str]:
    """The word itself with a mark behind it, and its prefixes from the longest to the shortest."""
    return [word + "$", *(word[:n] for n in reversed(PREFIXES) if n <= len(word))]


#: Characters of a text that are cut into tokens at a time.
PIECE = 1_000_000


def matches_of(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, int, int, float]], int]:
    """([(start, end, kind, weight)] of the text's matches, how many words it has); start and end count characters."""
    following, matches = grammar()
    state, words, out, waiting = 0, 0, [], (0, 0, 0.0)
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        # a piece ends behind a line or a blank, so no word is cut; a word longer than a piece is
        edge = max(text.rfind("\n", at, end), text.rfind(" ", at, end)) + 1 if end < len(text) else end
        end = edge if edge > at else end
        for m in _TOKEN.finditer(text, at, end):
            symbol, weight = lexicon[m.group()]
            words += symbol < QUOTE
            match = matches[state][symbol]
            if match is not None:
                kind, factor, earlier = match
                if earlier:
                    out.append((waiting[0], m.end(), kind, factor * waiting[2]))
                else:
                    out.append((m.start(), m.end(), kind, factor * weight))
            if symbol == INSULT or symbol == THREAT:
                waiting = (m.start(), m.end(), weight)
            state = following[state][symbol]
        at = end
    return out, words


def features(found: list[tuple[int, int, int, float]], words: int) -> tuple[float, float, float, float]:
    """What the score is made of: 1, the sum of weights, the same for each word, the heaviest match (all damped)."""
    total = sum(w for *_, w in found)
    return 1.0, math.log1p(total), math.log1p(100 * total / (words + 50)), max((w for *_, w in found), default=0.0) / 5


@dataclass(frozen=True)
class ToxicityModel:
    #: Insults by prefix, and the factors of the features.
    insults: dict[str, float] = field(default_factory=dict)
    factors: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0)

    def score(self, x) -> float:
        z = sum(a * b for a, b in zip(self.factors, x))
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))


#: Weight of a seed insult of which labels know nothing, in units of log-odds.
SEED = 3.0


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's steps for a logistic model, drawn to start by ridge."""
    b = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - ridge * (b - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = 20_000,
    lexicon_size: int = 20_000,
    evidence: float = 16.0,
    damping: float = 2.0,
) -> ToxicityModel:
    """Learn insults and the score's factors from labels (id_col, toxic 0 or 1).

    At most most_rows labelled ids are used, those with the smallest hash; an id with several labels has their
    majority (of equal ones, toxic), null ids and labels are left out. Equal texts among them count once. Of the
    texts, three quarters (by hash) make the lexicon: how many different words of toxic and other texts begin with a
    prefix (or are the whole word), as log-odds damped towards all words', where they stand in two toxic texts or more
    and the likelihood ratio (G squared) is `evidence` or more; the lexicon_size strongest are kept, at most. The last quarter fits the score's factors.
    Without labels the seed insults and fixed factors remain. Only text and label enter; other columns don't matter.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    votes = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = saved(votes.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most_rows))
    texts = plain.join(F.broadcast(chosen), "id").select("id", "toxic", F.sha2("text", 256).alias("h"))
    once = saved(texts.groupBy("h").agg(F.min("id").alias("id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    part = F.pmod(F.xxhash64("h"), F.lit(4)).alias("part")
    train = plain.join(F.broadcast(once.select("id", "toxic", part)), "id")

    def counted(batches):
        for batch in batches:
            for b in slices([batch], "text", 2_000_000):
                seen: dict[str, list[int]] = {}
                for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                    words = {m.group().lower().replace("’", "'") for m in _TOKEN.finditer(text)}
                    of_text = Counter(p for w in words if w[0].isalpha() for p in ("", *prefixes(w)))
                    for p, k in of_text.items():
                        c = seen.setdefault(p, [0, 0, 0])
                        c[toxic] += k
                        c[2] += toxic
                counts = np.array(list(seen.values()), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(counts[:, i]) for i in range(3))], names=["prefix", "other", "toxic", "texts"])

    names = ["other", "toxic", "texts"]
    parts = train.where("part > 0").select("text", "toxic").mapInArrow(counted, "prefix string, other long, toxic long, texts long")
    counts = saved(parts.groupBy("prefix").agg(*(F.sum(c).alias(c) for c in names)))
    insults = {w + "$": SEED for w in INSULTS}
    whole = counts.where("prefix = ''").first()
    if whole is None or not whole.toxic or not whole.other:
        return ToxicityModel(insults)
    bad, good = whole.toxic, whole.other
    share = bad / (bad + good)
    a, b = F.col("toxic"), F.col("other")
    n = a + b
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (term(a, n * share) + term(b, n * (1 - share)) + term(bad - a, (bad + good - n) * share) + term(good - b, (bad + good - n) * (1 - share)))
    odds = F.log((a + damping * share) / (b + damping * (1 - share))) - math.log(share / (1 - share))
    strong = counts.where((F.col("prefix") != "") & (F.col("texts") >= 2)).select("prefix", odds.alias("odds"), g2.alias("g2")).where((F.col("odds") > 1.5) & (F.col("g2") >= evidence))
    insults |= {r.prefix: min(r.odds, 6.0) for r in strong.orderBy(F.desc("g2"), "prefix").limit(lexicon_size).collect()}

    def fitted():
        lexicon = Lexicon(insults)

        def fn(texts):
            rows = [features(*matches_of(t, lexicon)) for t in texts]
            return None, [rows]

        return fn

    learned = mapped_text(train.where("part = 0").select("text", "toxic"), "text", "x array<double>", fitted).collect()
    start = np.array(ToxicityModel.factors)
    if not learned:
        return ToxicityModel(insults)
    factors = _logistic(np.array([r.x for r in learned]), np.array([r.toxic for r in learned], float), start)
    return ToxicityModel(insults, tuple(float(v) for v in factors))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """docs with n_words, matches, score and predicted; one row per input row, nothing shuffles.

    matches: array of (start, end, kind, weight) of the matched clauses, places in characters. score: 0 to 1, higher
    is likelier toxic. predicted: 1 if score >= 0.5. A null text is judged like an empty one: no words, no matches,
    the score of the factors alone. Texts are judged whole and each for itself, so copies and null ids don't matter;
    very long ones are cut into tokens in pieces. An empty table gives an empty one. Input columns named like an
    output column are replaced.
    """

    def work():
        lexicon = Lexicon(model.insults)

        def fn(texts):
            words, found, scores = [], [], []
            for t in texts:
                m, n = matches_of(t or "", lexicon)
                words.append(n)
                found.append([{"start": s, "end": e, "kind": KINDS[k], "weight": w} for s, e, k, w in m])
                scores.append(model.score(features(m, n)))
            return None, [words, found, scores, [int(s >= 0.5) for s in scores]]

        return fn

    added = "n_words long, matches array<struct<start: int, end: int, kind: string, weight: double>>, score double, predicted int"
    return mapped_text(docs, text_col, added, work, keep_text, keep)


def held_out(id_col: str = "doc_id", of: int = 5):
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == 0, F.lit(False))
