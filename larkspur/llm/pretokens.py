"""Pre-tokens and byte-pair merging on ragged numpy arrays, for whole batches of texts at once.

A batch is one array of code points. Character classes come from a table, token borders from
class changes, and equal pre-tokens are merged only once: a hash finds those that may be equal, their bytes
decide, and a worker keeps the results by the pre-token itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from .bytewords import same_runs

SPACE, LETTER, DIGIT, OTHER, END = range(5)
_END = 0x110000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Units longer than this are cut where no pre-token can cross: before a lone space between two other characters,
#: or between a letter and a mark of punctuation.
UNIT_CHARS = 1_000_000
_EDGE = regex.compile(r"(?<=\S)(?= \S)|(?<=[A-Za-z\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3])(?=[!-&(-/:-@\[-_{-~\u3001\u3002\uFF0C])")
#: Distinct pre-tokens kept from batch to batch by one worker.
CACHE_ENTRIES = 300_000


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point, by the tokenizers library's own tables, whatever edition of Unicode those are."""
    table = np.full(_END + 1, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, _END)]))
    chars = "".join(regex.findall(r"[\p{L}\p{N}\p{White_Space}]+", chars))  # a superset, to be quick
    codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (begin, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars):
            table[codes[begin:end]] = kind
    table[_END] = END
    return table


def _codes(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts behind each other, an end mark after each; where the marks are."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    codes[ends] = _END
    return joined, codes, ends


def _borders(codes: np.ndarray, ends: np.ndarray, with_space: bool) -> np.ndarray:
    """Where a pre-token begins. with_space: one space goes with what follows it, digits form runs and
    white space is kept; else digits stand alone and white space is dropped later."""
    kind = char_classes()[codes]
    start = np.ones(len(codes), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[ends] = True
    start[np.minimum(ends + 1, len(codes) - 1)] = True
    if with_space:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
    else:
        start[kind == DIGIT] = True
    quote = np.flatnonzero(codes == 39)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a, b = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        e, r, v, el = (ord(c) for c in "ervl")
        short = quote[np.isin(a, [ord(c) for c in "stmd"])]
        long = quote[((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == el) & (b == el))]
        start[short + 1] = False
        start[short + 2] = True
        start[long + 1] = False
        start[long + 3] = True
    return start


#: The two layouts of tokenizers files that the borders and lower-casing above stand for.
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_LAYOUT = {"normalizer": None, "pre_tokenizer": {**_LEVEL, "use_regex": True}}
WORD_LAYOUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {**_LEVEL, "use_regex": False}]},
}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def known_layout(path: str) -> dict:
    """The tokenizers file at path; an error if it isn't a BPE file of one of the two layouts."""
    if not path.endswith(".json"):
        raise ValueError(f"{path}: only .json files of the tokenizers library are read, no sentencepiece models")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    layout = WORD_LAYOUT if spec["model"].get("end_of_word_suffix") else BYTE_LAYOUT
    wrong = [k for k, v in layout.items() if spec.get(k) != v] + [f"model.{k}" for k, v in PLAIN_MODEL.items() if spec["model"].get(k, v) != v]
    wrong += [f"added token {t['content']}" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    wrong += [k for k in ("truncation", "padding") if spec.get(k)]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)} not as in the known layouts of BPE files")
    return spec


class MergeTable:
    """Merges of a tokenizers file, in an open-addressing table: pair of ids to rank and merged id."""

    SLOTS = 1 << 19

    def __init__(self, path: str):
        spec = known_layout(path)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.with_space = not suffix
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        # byte-level files write a byte as itself if it is printable, else as the next unused letter from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = dict(zip(shown + [b for b in range(256) if b not in shown], map(chr, [*shown, *range(256, 512)])))
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right, out = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.slot_rank = np.full(self.SLOTS, len(pairs), np.int64)
        self.slot_out = np.zeros(self.SLOTS, np.int64)
        self.none = len(pairs)
        key, rank = (left << 20) | right, np.arange(len(pairs))
        at, self.probes = self._slot(key), 1
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.keys[at[take]], self.slot_rank[at[take]], self.slot_out[at[take]] = key[take], rank[take], out[take]
            left_over = np.ones(len(key), bool)
            left_over[take] = False
            key, rank, out, at = key[left_over], rank[left_over], out[left_over], (at[left_over] + 1) % self.SLOTS
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _PRIME) >> np.uint64(45)).astype(np.int64)

    def ranks(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (none: no such merge), and its slot."""
        at = self._slot(key)
        found = self.keys[at]
        rank = np.where(found == key, self.slot_rank[at], self.none)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % self.SLOTS
            found = self.keys[at[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return rank, at

    def merge(self, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank-synchronous merging. symbols: ids of all sequences behind each other; seq: the sequence of
        each, ascending. In each round every sequence applies its own lowest-ranked pair at all its places,
        from the left; sequences without a pair leave. Returns what survives, ordered by sequence."""
        over: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), self.none, np.int64)
            slot = np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                rank[:-1], slot[:-1] = self.ranks((symbols[:-1] << 20) | symbols[1:])
                rank[:-1][seq[:-1] != seq[1:]] = self.none
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[first, len(seq)])
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            idle = least == self.none
            if idle.any():
                over.append((symbols[idle], seq[idle]))
                busy = ~idle
                symbols, seq, rank, slot, least = symbols[busy], seq[busy], rank[busy], slot[busy], least[busy]
                if not len(symbols):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            if (np.diff(at) == 1).any():  # a run of equal symbols: every other place, from its left end
                run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                within = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at = at[within % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.slot_out[slot[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, seq = symbols[stay], seq[stay]
        if not over:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, seq = (np.concatenate(x) for x in zip(*over))
        order = np.argsort(seq, kind="stable")
        return symbols[order], seq[order]


@functools.lru_cache(4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _lowered(text: str) -> str:
    """Composed form in lower case, letter by letter, for word files."""
    if text.isascii():
        return text.lower()
    if np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() < 0x1C80:  # editions of Unicode agree
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return Sequence([NFC(), Lowercase()]).normalize_str(text)


def _cut(text: str) -> list[str]:
    """text in units of about UNIT_CHARS."""
    out, begin = [], 0
    while len(text) - begin > UNIT_CHARS and (edge := _EDGE.search(text, begin + UNIT_CHARS)):
        out.append(text[begin : edge.start()])
        begin = edge.start()
    return [*out, text[begin:]]


class BatchEncoder:
    """Token ids of batches of texts, as the tokenizers library gives them for this file without added tokens."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.begin, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.table.inner[data]
        symbols[np.cumsum(sizes) - 1] = self.table.final[data[np.cumsum(sizes) - 1]]
        symbols, seq = self.table.merge(symbols, np.repeat(np.arange(len(raw)), sizes))
        lengths = np.bincount(seq, minlength=len(raw))
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(lengths) - lengths]
        self.known.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words))))
        self.lengths = np.r_[self.lengths, lengths]
        self.ids = np.r_[self.ids, symbols]

    def _units(self, units: list[str], with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens of each unit, and all ids in order."""
        joined, codes, ends = _codes(units)
        starts = np.flatnonzero(_borders(codes, ends, self.table.with_space))
        sizes = np.diff(np.r_[starts, len(codes)])
        if self.table.with_space:
            real = codes[starts] != _END
        else:
            real = ~np.isin(char_classes()[codes[starts]], (SPACE, END))
        starts, sizes = starts[real], sizes[real]
        unit = np.searchsorted(ends, starts)
        if not len(starts):
            return np.zeros(len(units), np.int64), np.zeros(0, np.int64)
        first, group = same_runs(codes.view(np.uint8), starts * 4, sizes * 4)
        words = [joined[s : s + n] for s, n in zip(starts[first].tolist(), sizes[first].tolist())]
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self._forget()
            new = words
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[at][group]
        counts = np.bincount(unit, weights=lengths, minlength=len(units)).astype(np.int64)
        if not with_ids:
            return counts, None
        begin = self.begin[at][group]
        where = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return counts, self.ids[where]

    def _plan(self, texts: list[str | None]) -> tuple[list[str], list[tuple[int, int]]]:
        """Units of all texts, and (text, unit or ~special id) in order."""
        units: list[str] = []
        plan: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            parts: list[str | int] = [text]
            if self.special is not None and any(x in text for x in self.table.special):
                parts, begin = [], 0
                for m in self.special.finditer(text):
                    parts += [text[begin : m.start()], self.table.special[m[0]]]
                    begin = m.end()
                parts.append(text[begin:])
            for part in parts:
                if isinstance(part, int):
                    plan.append((i, ~part))
                elif part:
                    if not self.table.with_space:
                        part = _lowered(part)
                    for unit in _cut(part):
                        plan.append((i, len(units)))
                        units.append(unit)
        return units, plan

    def counts(self, texts: list[str | None]) -> np.ndarray:
        units, plan = self._plan(texts)
        of_unit = self._units(units, False)[0] if units else np.zeros(0, np.int64)
        out = np.zeros(len(texts), np.int64)
        for i, unit in plan:
            out[i] += of_unit[unit] if unit >= 0 else 1
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts behind each other (uint32)."""
        units, plan = self._plan(texts)
        of_unit, ids = self._units(units, True) if units else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out = np.zeros(len(texts), np.int64)
        for i, unit in plan:
            out[i] += of_unit[unit] if unit >= 0 else 1
        if any(unit < 0 for _, unit in plan):
            begin = np.cumsum(of_unit) - of_unit
            ids = np.concatenate([ids[begin[u] : begin[u] + of_unit[u]] if u >= 0 else [~u] for _, u in plan])
        return out, ids.astype(np.uint32)


@functools.lru_cache(4)
def encoder(path: str) -> BatchEncoder:
    """One per worker and file, so that its known pre-tokens last from batch to batch."""
    return BatchEncoder(path)
