"""Operator 10, quality rules by repetition coverage.

All texts of a batch are one byte array. Equal words get equal numbers, windows of several word counts get
rolling hashes, which find the windows that may be equal and their numbers confirm, and a window found twice in
its document covers its words; the rules look at the share of
characters that such windows and repeated lines cover. No shuffle: each row is judged where it was read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .bytewords import END, is_space, same_runs, same_windows, words_of
from .cluster import mapped_text


@dataclass(frozen=True)
class Rules:
    """What a document may have at most; shares are of the characters in words."""

    least_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    #: Words in a window: most characters inside windows of that many words that are found twice or more.
    windows: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22})
    #: Most characters inside lines that equal an earlier line.
    line_share: float = 0.20
    #: Most characters of `[#*$%&|<>]` for each word.
    symbols_per_word: float = 0.40


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[str | None], windows: list[int]) -> dict[str | int, np.ndarray]:
    """Counts of each text; under a window's word count, (words, characters) inside its repeated windows."""
    data, ends, starts, sizes, doc = words_of(texts)
    n = len(texts)
    lead = ~is_space(data) & ((data & 0xC0) != 0x80)  # the first byte of each character of a word
    chars = np.add.reduceat(lead, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    out: dict[str | int, np.ndarray] = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, chars, n).astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(ends, np.flatnonzero(_SYMBOL[data])), minlength=n),
    }
    words = same_runs(data, starts, sizes)[1]
    for k in windows:
        count, covered = len(words) - k + 1, np.zeros(len(words), bool)
        if count > 0:
            one = np.flatnonzero(doc[:count] == doc[k - 1 :])
            group = same_windows(words, doc, one, k)
            hit = one[np.bincount(group, minlength=1)[group] > 1]
            if len(hit):
                edge = np.zeros(len(words) + 1, np.int32)
                edge[hit] += 1
                np.subtract.at(edge, hit + k, 1)
                covered = np.cumsum(edge[:-1]) > 0
        out[k] = np.stack([np.bincount(doc, covered, n), np.bincount(doc, covered * chars, n)]).astype(np.int64)
    # lines with a word
    cut = np.flatnonzero((data == 10) | (data == END))
    first = np.r_[0, cut[:-1] + 1]
    full = np.searchsorted(starts, cut) > np.searchsorted(starts, first)
    first, cut = first[full], cut[full]
    line_doc = np.searchsorted(ends, first)
    kinds, line = same_runs(data, first, cut - first)
    later = _later(line_doc * max(len(kinds), 1) + line)
    line_chars = np.add.reduceat(lead, np.stack([first, cut], 1).reshape(-1), dtype=np.int64)[::2] if len(first) else np.zeros(0, np.int64)
    out["n_dup_lines"] = np.bincount(line_doc, later, n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc, later * line_chars, n).astype(np.int64)
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """docs with the rules' counts and verdict; one row per input row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (too few words, or too many of
    them in repeated windows of base_window words), dup_chars (characters inside repeated windows of the
    rules' shortest length), dup_line_chars, kept. Null and empty texts have no words and fail. Texts are
    judged whole and each for itself, so copies and null ids don't matter; an empty table gives an empty
    one. Input columns named like an output column are replaced.
    """
    windows = sorted({rules.base_window, *rules.windows})

    def work():
        def fn(texts):
            m = measure(texts, windows)
            words, chars, repeated = m["n_words"], m["word_chars"], m[rules.base_window][0]
            base = (words < rules.least_words) | (100 * repeated > rules.base_percent * words)
            good = ~base & (m["n_symbols"] <= rules.symbols_per_word * words) & (m["dup_line_chars"] <= rules.line_share * chars)
            for k, share in rules.windows.items():
                good &= m[k][1] <= share * chars
            return None, [words, chars, m["n_symbols"], m["n_dup_lines"], repeated, base, m[min(rules.windows)][1], m["dup_line_chars"], good]

        return fn

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_chars long, dup_line_chars long, kept boolean"
    return mapped_text(docs, text_col, added, work, keep_text, keep)
