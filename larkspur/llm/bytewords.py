"""Words of a batch of texts as runs in one byte array, their exact groups and hashes."""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
END = 0xFF  # no byte of UTF-8; stands behind each text


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13)) | (data == END)


def words_of(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each ends, where words start, their sizes, the text of each word).

    Words are runs of bytes other than [\\x20\\x09-\\x0D]. lower: A-Z become a-z.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    space = is_space(data)
    start, stop = ~space, ~space
    start[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    starts = np.flatnonzero(start)
    return data, ends, starts, np.flatnonzero(stop) + 1 - starts, np.searchsorted(ends, starts)


#: Runs of more bytes than this are hashed by BLAKE2b, one by one.
LONG_RUN = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * PRIME
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as little-endian numbers."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))


def hashed_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, chained over 8 bytes at a time, to find equal runs quickly. Different
    runs may share one, so same_runs compares the bytes."""
    out = mixed(sizes.astype(np.uint64) * PRIME)
    eight = _eights(data)
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG_RUN))
    for done in range(0, LONG_RUN, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        unused = np.maximum(done + 8 - sizes[at], 0).astype(np.uint64) * np.uint64(8)
        out[at] = mixed(out[at] ^ (eight[starts[at] + done] << unused))
    for i in np.flatnonzero(sizes > LONG_RUN).tolist():
        digest = hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def equal_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of the run whose number is in other."""
    same = sizes == sizes[other]
    eight = _eights(data)
    at = np.flatnonzero(same & (other != np.arange(len(other))))
    long = at[sizes[at] > LONG_RUN]
    at = at[sizes[at] <= LONG_RUN]
    for done in range(0, LONG_RUN, 8):
        at = at[sizes[at] > done]
        if not len(at):
            break
        unused = np.maximum(done + 8 - sizes[at], 0).astype(np.uint64) * np.uint64(8)
        differ = ((eight[starts[at] + done] ^ eight[starts[other[at]] + done]) << unused) != 0
        same[at[differ]] = False
        at = at[~differ]
    for i in long.tolist():
        a, b, n = starts[i], starts[other[i]], sizes[i]
        same[i] = np.array_equal(data[a : a + n], data[b : b + n])
    return same


def same_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a run of each distinct content, the number of each run's content): equal bytes have equal numbers and different bytes
    different ones, whatever their hashes."""
    _, first, group = np.unique(hashed_runs(data, starts, sizes), return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~equal_runs(data, starts, sizes, first[group]))
    if len(wrong):
        found: dict[bytes, int] = {}
        more = []
        for i in wrong.tolist():
            run = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if run not in found:
                found[run] = len(first) + len(more)
                more.append(i)
            group[i] = found[run]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return first, group


def same_windows(numbers: np.ndarray, owner: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of `width` numbers from the places at: the same for equal windows of one owner only.

    Rolling hashes find the windows that may be equal, their numbers decide.
    """
    key = owner[at].astype(np.uint64) * PRIME
    for j in range(width):
        key = key * MIX + numbers[at + j].astype(np.uint64)
    _, first, group = np.unique(mixed(key), return_index=True, return_inverse=True)
    like = at[first][group]
    same = owner[at] == owner[like]
    for j in range(width):
        same &= numbers[at + j] == numbers[like + j]
    found: dict[tuple, int] = {}
    for i in np.flatnonzero(~same).tolist():
        group[i] = found.setdefault((int(owner[at[i]]), *numbers[at[i] : at[i] + width].tolist()), len(first) + len(found))
    return group


#: Hashes of distinct words that a worker keeps.
CACHE_WORDS = 100_000
_WORDS: dict[bytes, int] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BLAKE2b of each word, 64 bits, worked out once for each distinct one: for hashes that meet those of other batches."""
    first, group = same_runs(data, starts, sizes)
    raw = data.tobytes()
    if len(_WORDS) + len(first) > CACHE_WORDS:
        _WORDS.clear()
    out = np.empty(len(first), np.uint64)
    for k, (s, n) in enumerate(zip(starts[first].tolist(), sizes[first].tolist())):
        word = raw[s : s + n]
        h = _WORDS.get(word)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            if n <= LONG_RUN:
                _WORDS[word] = h
        out[k] = h
    return out[group]
