"""What a pattern can begin with, so that a search tries it only where it may begin."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Parts that other engines read differently, or that lose their meaning apart from the rest of a pattern: flags, names, back references, quoting, classes within classes.
_WHOLE = re.compile(r"\(\?[a-zA-Z#(]|\(\?<[a-zA-Z]|\\[0-9QEkpPGRX]|&&")
_KINDS = {K.CATEGORY_DIGIT: "0123456789", K.CATEGORY_SPACE: " \t\n\x0b\f\r"}


def alternatives(pattern: str) -> list[str]:
    """The parts between the bars outside of groups and classes; the pattern as it is where that isn't plain."""
    if _WHOLE.search(pattern):
        return [pattern]
    parts, depth, klass, i, start = [], 0, None, 0, 0
    while i < len(pattern):
        x = pattern[i]
        if x == "\\":
            i += 1
        elif klass is not None:
            if x == "[":
                return [pattern]
            if x == "]" and i > klass:
                klass = None
        elif x == "[":
            klass = i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1
        elif x in "()":
            depth += 1 if x == "(" else -1
        elif x == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def first_characters(pattern: str) -> frozenset[str]:
    """Characters, letters in lower case, one of which begins every match; none where that isn't known, or a match can be empty."""
    if _WHOLE.search(pattern):
        return frozenset()
    try:
        first, empty = _of_all(_parser.parse(pattern))
    except (re.error, LookupError):
        return frozenset()
    return frozenset() if empty else frozenset(x.lower() if x.isascii() else x for x in first)


def _of_all(items) -> tuple[set[str], bool]:
    """First characters of parts one after another, and whether all can be empty. LookupError where they aren't known."""
    first: set[str] = set()
    for kind, value in items:
        found, empty = _of(kind, value)
        first |= found
        if not empty:
            return first, False
    return first, True


def _of(kind, value) -> tuple[set[str], bool]:
    if kind is K.LITERAL:
        return {chr(value)}, False
    if kind in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return set(), True
    if kind is K.IN:
        return set().union(*(_in_class(k, v) for k, v in value)), False
    if kind is K.BRANCH:
        found = [_of_all(b) for b in value[1]]
        return set().union(*(f for f, _ in found)), any(e for _, e in found)
    if kind is K.SUBPATTERN and not value[1] and not value[2]:
        return _of_all(value[3])
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT):
        found, empty = _of_all(value[2])
        return found, empty or value[0] == 0
    raise LookupError(kind)


def _in_class(kind, value) -> set[str]:
    if kind is K.LITERAL:
        return {chr(value)}
    if kind is K.RANGE and value[1] - value[0] < 64:
        return {chr(x) for x in range(value[0], value[1] + 1)}
    if kind is K.CATEGORY and value in _KINDS:
        return set(_KINDS[value])
    raise LookupError(kind)


def one_of(characters: frozenset[str]) -> str:
    """A class that holds the characters, ASCII letters in either case. Many Hebrew letters are one range: more may pass, never less."""
    hebrew = {x for x in characters if "א" <= x <= "ת"}
    plain = characters - hebrew if len(hebrew) > 3 else characters
    both = sorted({y for x in plain for y in ((x.lower(), x.upper()) if x.isascii() else (x,))})
    return "[" + "".join(x if x.isalnum() else rf"\x{{{ord(x):x}}}" for x in both) + ("א-ת" if len(hebrew) > 3 else "") + "]"
