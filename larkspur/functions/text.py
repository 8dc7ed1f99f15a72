"""Text and value helpers whose results follow the loose rules of the job records: empty strings count
as missing, white space includes no-break spaces, word borders are ASCII."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import may_hold
from .starts import alternatives, first_characters, one_of


def truthy(c: Column) -> Column:
    """True where a string is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def or_else(*cs: Column) -> Column:
    """The first string that is neither null nor empty; the last argument as it is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs[:-1]), cs[-1])


def join_truthy(separator: str, *cs: Column) -> Column:
    """The strings that are neither null nor empty, joined; array columns add their elements."""
    return F.array_join(F.filter(F.array(*cs), truthy), separator)


def text_of(*cs: Column, arrays: Sequence[Column] = ()) -> Column:
    """What the rules look at: all non-empty parts joined by spaces."""
    parts = F.array(*(c.cast("string") for c in cs))
    for a in arrays:
        parts = F.concat(parts, F.coalesce(a, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, truthy), " ")


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once. A generator of one row stands between them and their uses, so the optimizer
    doesn't copy a long expression into each place that reads it."""
    kept = [n for n in rows.columns if n not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, where a column of its own (held) can't be had: within arrays and their functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_spaces(c: Column) -> Column:
    """No-break spaces and byte-order marks as spaces; done once on ingest, since Java's \\s knows neither."""
    nbsp, mark = (F.lit(x) for x in " ﻿")
    return F.replace(F.replace(c, nbsp, F.lit(" ")), mark, F.lit(" "))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty. A space alone, as most are, is no match and stays."""
    return F.trim(F.regexp_replace(plain_spaces(F.coalesce(c, F.lit(""))), r" \s+|[^\S ]\s*", " "))


def normalized(c: Column) -> Column:
    """Lower case, one kind of apostrophe, squeezed."""
    return squeezed(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")))


def word_borders(pattern: str) -> str:
    """\\b of a pattern as ASCII borders, so that a letter of another alphabet is no part of a word."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


@cache
def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern that is found where one of the patterns is, letters of either case.

    Alternatives are dealt by the characters they can begin with, so a place of the text is tried against those that may
    begin there and not against all. Those that may begin with anything, or be empty, are tried everywhere.
    """
    everywhere, by_first, wide = [], {}, []
    for a in (a for p in patterns for a in alternatives(p)):
        first, a = first_characters(a), word_borders(a)
        if not first:
            everywhere.append(a)
        elif len(first) > 4:
            wide.append((first, a))
        else:
            for x in sorted(first):
                by_first.setdefault(x, []).append(a)
    either = lambda of: "|".join(f"(?:{a})" for a in of)
    dealt = [*((frozenset(x), either(of)) for x, of in by_first.items()), *wide]
    if not dealt:
        return f"(?i){either(everywhere)}"
    begins = "|".join(f"(?={one_of(first)})(?:{a})" for first, a in dealt)
    guarded = f"(?={one_of(frozenset().union(*(first for first, _ in dealt)))})(?i:{begins})"
    return f"(?i:{either(everywhere)})|{guarded}" if everywhere else guarded


def matches(c: Column, *patterns: str) -> Column:
    """True where one of the patterns is found, letters of either case; null counts as empty."""
    if not patterns:
        return F.lit(False)
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(any_of(patterns)))


def seen(c: Column, *patterns: str) -> Column:
    """The same as matches, for columns of long texts: only texts that a search in linear time doesn't rule out are read by the
    patterns. Not for arrays' elements, which no Python worker sees."""
    text = F.coalesce(c, F.lit(""))
    may = may_hold(text, patterns) if patterns else None
    return matches(c, *patterns) if may is None else may & matches(c, *patterns)


def found_in(text: str | None, *patterns: str) -> bool:
    """What matches says of a plain string: letters of either case and white space are ASCII's there too."""
    return bool(patterns) and re.search("|".join(f"(?:{word_borders(p)})" for p in patterns), text or "", re.IGNORECASE | re.ASCII) is not None


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up (also below zero)."""
    return F.floor(c + 0.5).cast("int")


def clamped(c: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(as_column(high), c))


def tail(a: Column, n: int) -> Column:
    """The last n elements of an array, all of a shorter one."""
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)


def number_or(c: Column, default: float = 0.0) -> Column:
    """A number from a string or number; the default where there is none, or 0."""
    return F.coalesce(F.nullif(F.expr("cast(null as double)") if c is None else c.try_cast("double"), F.lit(0.0)), F.lit(default))


def split_list(c: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def same_text(a: Column, b: Column) -> Column:
    """Both there, and equal once normalized."""
    return truthy(a) & truthy(b) & (normalized(a) == normalized(b))


def base64url(c: Column) -> Column:
    """UTF-8 bytes in URL-safe base64 without padding."""
    coded = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    return F.rtrim(F.translate(coded, "+/", "-_"), F.lit("="))


def unbase64url(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")


def slug_id(*cs: Column, longest: int = 160) -> Column:
    """A readable id: parts joined by |, lower case, without schemes, other characters as single dashes."""
    raw = F.regexp_replace(normalized(join_truthy("|", *cs)), "https?://", "")
    return F.substring(F.trim(F.regexp_replace(raw, "[^a-z0-9א-ת]+", "-"), F.lit("-")), 1, longest)


#: Words that carry no meaning for similarity.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "role", "job", "jobs", "דרושים", "משרה", "תפקיד", "עם", "של", "על", "אל", "או", "גם", "ללא", "עבודה", "דרוש", "דרושה", "דרוש/ה", "חברה", "לחברה", "באזור", "תחום", "עבור", "את"]


def tokens(text: Column, most: int = 160, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The first `most` words of three characters or more that are no stop words, then made distinct."""
    safe = F.regexp_replace(normalized(text), r"[^a-z0-9א-ת+#.\s-]", " ")
    words = F.filter(F.split(safe, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(list(stop_words)))
    return F.array_distinct(F.slice(words, 1, most))


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """The words that the normalized text contains, in their order. ASCII words of under three letters, and
    words of one letter, are passed over."""
    import regex

    usable = []
    for w in (w.strip() for w in words if w):
        clean = regex.sub(r"[^\p{L}\p{N}+#.\-]", "", w)
        if len(clean) >= 2 and not (clean.isascii() and len(clean) < 3):
            usable.append(w)
    if not usable:
        return F.array().cast("array<string>")
    t = normalized(text)
    return F.array_compact(F.array(*(F.when(F.contains(t, normalized(F.lit(w))), F.lit(w)) for w in usable)))


def years_at_least(text: Column, years: int) -> Column:
    """A number of years of experience, in one of three phrasings, of at least `years`."""
    t = normalized(text)
    unit, practice = "(?:years?|yrs?|שנים|שנות|שנה)", "(?:ניסיון|נסיון|experience)"
    phrasings = (rf"(\d+)\+?\s*{unit}", rf"{practice}.{{0,50}}?(\d+)\+?", rf"(\d+)\+?.{{0,25}}?{practice}")
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in phrasings]
    may = may_hold(t, tuple(p.replace("(\\d+)", "\\d+") for p in phrasings))
    return may & F.exists(F.concat(*found), lambda n: F.coalesce(n.try_cast("double") >= years, F.lit(False)))
