"""Patterns as ones for a search in linear time, so that long texts are read by the slow search only where it may find something."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as K
from re import _parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that have no plain counterpart: flags, names, quoting, classes within classes.
_OTHER = re.compile(r"\(\?[a-zA-Z#(]|\(\?<[a-zA-Z]|\\[0-9QEkpPGRX]|&&")
#: Classes of Unicode properties alone: other engines know other versions of these, so they stand for any character.
_PROPERTIES = re.compile(r"\[\^?(?:\\p\{\w+\})+\]")
_CATEGORIES = {
    K.CATEGORY_DIGIT: "0-9", K.CATEGORY_SPACE: r" \t\n\x0b\x0c\r", K.CATEGORY_WORD: "0-9A-Za-z_",
}
_OUTSIDE = {K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_NOT_WORD: r"\W"}


def _written(code: int) -> str:
    return rf"\x{{{code:x}}}"


def _literal(code: int) -> str:
    x = chr(code)
    return f"[{x.lower()}{x.upper()}]" if x.isascii() and x.isalpha() else _written(code)


def _range(low: int, high: int) -> str:
    """A range with the other case of its ASCII letters."""
    out = f"{_written(low)}-{_written(high)}"
    for first, last, shift in ((65, 90, 32), (97, 122, -32)):
        a, b = max(low, first), min(high, last)
        if a <= b:
            out += f"{_written(a + shift)}-{_written(b + shift)}"
    return out


def _in_class(items) -> str:
    kinds = [k for k, _ in items]
    out = ""
    for kind, value in items:
        if kind is K.LITERAL:
            out += _range(value, value)
        elif kind is K.RANGE:
            out += _range(*value)
        elif kind is K.CATEGORY and value in _CATEGORIES:
            out += _CATEGORIES[value]
        elif kind is K.CATEGORY and value in _OUTSIDE and K.NEGATE not in kinds:
            out += _OUTSIDE[value]
        elif kind is not K.NEGATE:
            raise LookupError(kind)
    return f"[{'^' if K.NEGATE in kinds else ''}{out}]"


def _one(kind, value) -> str:
    if kind is K.LITERAL:
        return _literal(value)
    if kind is K.NOT_LITERAL:
        return f"[^{_range(value, value)}]"
    if kind is K.ANY:
        return "(?s:.)"
    if kind is K.IN:
        return _in_class(value)
    if kind is K.BRANCH:
        return "(?:" + "|".join(map(_all, value[1])) + ")"
    if kind is K.SUBPATTERN and not value[1] and not value[2]:
        return f"(?:{_all(value[3])})"
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, what = value
        return f"(?:{_all(what)}){{{low},{'' if high is K.MAXREPEAT else high}}}"
    if kind is K.AT and value is K.AT_BEGINNING:
        return "^"
    if (kind is K.AT and value in (K.AT_END, K.AT_BOUNDARY)) or kind in (K.ASSERT, K.ASSERT_NOT):
        return ""  # a condition on what stands around: without it more is found, never less
    raise LookupError(kind)


def _all(items) -> str:
    return "".join(_one(kind, value) for kind, value in items)


@cache
def wider(patterns: tuple[str, ...]) -> str | None:
    """A pattern for RE2 that is found wherever one of the patterns is, ASCII letters of either case, and perhaps elsewhere;
    None where there is none."""
    out = []
    for p in patterns:
        p = _PROPERTIES.sub(".", p)
        if _OTHER.search(p):
            return None
        try:
            out.append(f"(?:{_all(_parser.parse(p))})")
        except (re.error, LookupError):
            return None
    made = "|".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), made)
    except pa.ArrowInvalid:
        return None
    return made


@cache
def _found(pattern: str):
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return F.arrow_udf(found, "boolean")


def may_hold(text: Column, patterns: tuple[str, ...]) -> Column | None:
    """False only where none of the patterns is found in the text, which isn't null; None where that can't be told."""
    pattern = wider(patterns)
    return None if pattern is None else _found(pattern)(text)
