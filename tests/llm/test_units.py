"""The operators' numpy and Python parts against brute force, without Spark."""

import itertools
import math
import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from larkspur.llm import dedup_near, packing, pretokens, quality_rules, token_files  # noqa: E402

ODD = ["", " ", "a", "it's we're they'll I'd 'sup  's", "a<|endoftext|>b <|startoftext|> x", "x" * 3000, "\n\n b\t", "É漢字 ½²3 😀!!", "Σίσυφος ΣΣ İ", "a b c\r\n"]


def random_texts(n, seed=0):
    r = random.Random(seed)
    letters = "aab'stmdrevl  \n\t!?.,09½²ßÀéΣσİ  漢字́😀<|endoftext|>ABC'S"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)] + ["".join(chr(r.choice([r.randrange(32, 0x2000), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x1F900)])) for _ in range(40)) for _ in range(n // 4)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_as_the_library_gives_them(name):
    from tokenizers import Tokenizer

    texts = ODD + random_texts(400)
    n, ids = pretokens.BatchEncoder(P.path(name)).encode([*texts, None])
    assert n[-1] == 0 and (pretokens.BatchEncoder(P.path(name)).counts([*texts, None]) == n).all()
    begin = np.cumsum(n) - n
    want = Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)
    assert [ids[b : b + k].tolist() for b, k in zip(begin, n)][:-1] == [w.ids for w in want]


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    monkeypatch.setattr(pretokens, "UNIT_CHARS", 20)
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 8)
    texts = ["some words  and 12 numbers, then!  more words " * 9, "y" * 100]
    small = pretokens.BatchEncoder(P.path("byte_bpe_50k.json")).encode(texts)
    monkeypatch.undo()
    whole = pretokens.BatchEncoder(P.path("byte_bpe_50k.json")).encode(texts)
    assert (small[0] == whole[0]).all() and (small[1] == whole[1]).all()


def brute_bins(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + items[i] <= capacity:
                rest = list(bins)
                rest[rest.index(k)] += items[i]
                place(i + 1, rest)
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_packing_is_as_tight_as_brute_force():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.randrange(8, 24)
        items = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 9))), reverse=True)
        histogram = {k: items.count(k) for k in set(items)}
        plan = packing.plan_bins(histogram, capacity)
        used = {}
        for uses, times in plan:
            assert sum(k * n for k, n in uses) <= capacity
            for k, n in uses:
                used[k] = used.get(k, 0) + n * times
        assert used == histogram
        assert sum(t for _, t in plan) == brute_bins(items, capacity), (items, capacity)
    with pytest.raises(ValueError):
        packing.plan_bins({9: 1}, 8)


def test_packing_finds_perfect_packings():
    """1,000 instances of 10 to 25 items that fill 3 to 8 bins without waste, and one that greedy completions miss."""
    r = random.Random(11)
    hard = [638, 638, 386, 357, 335, 284, 268, 263, 202, 192, 176, 140, 115, 102]
    instances = [(hard, 1024, 4)]
    while len(instances) < 1001:
        bins, capacity, items = r.randrange(3, 9), r.choice([30, 64, 100, 256, 500, 1024]), []
        for _ in range(bins):
            cuts = sorted(r.sample(range(1, capacity), r.randrange(1, 5)))
            items += [b - a for a, b in zip([0, *cuts], [*cuts, capacity])]
        if 10 <= len(items) <= 25:
            instances.append((items, capacity, bins))
    for items, capacity, bins in instances:
        plan = packing.plan_bins({k: items.count(k) for k in set(items)}, capacity)
        assert sum(t for _, t in plan) == bins, (items, capacity)


def test_fillings_are_those_that_nothing_dominates():
    def dominated(b, others):
        """Whether some other set's items can hold those of b in groups."""
        def fits(items, rooms):
            if not items:
                return True
            return any(fits(items[1:], sorted([*rooms[:i], x - items[0], *rooms[i + 1 :]], reverse=True)) for i, x in enumerate(rooms) if x >= items[0])

        return any(a != b and fits(sorted(b, reverse=True), sorted(a, reverse=True)) and not (len(a) == len(b) and sorted(a) == sorted(b)) for a in others)

    r = random.Random(8)
    for _ in range(60):
        capacity = r.randrange(12, 40)
        items = [r.randrange(1, capacity // 2) for _ in range(r.randrange(3, 9))]
        largest = max(items)
        rest = list(items)
        rest.remove(largest)
        feasible = {tuple(sorted(c)) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if sum(c) <= capacity - largest}
        want = {x for x in feasible if not dominated(x, feasible)}
        counts = np.bincount(items, minlength=capacity + 1)
        got = []
        for waste, uses in packing.fillings(counts, largest, capacity, capacity, packing._Budget(10**6)):
            got.append(tuple(sorted(k for k, n in uses.items() for _ in range(n - (k == largest)))))
            assert waste == capacity - largest - sum(got[-1])
        assert len(got) == len(set(got)) and set(got) == want, (items, capacity)


def test_packing_meets_the_bound_on_many():
    r = np.random.default_rng(1)
    n = np.bincount(np.clip(r.lognormal(5, 1.2, 50_000), 1, 1024).astype(int), minlength=1025)
    plan = packing.plan_bins({i: int(k) for i, k in enumerate(n) if k}, 1024)
    assert sum(t for _, t in plan) <= packing.least_bins(n, 1024) + 1


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_never_worse_than_best_fit(seed):
    r = np.random.default_rng(seed)
    n = np.bincount(np.clip(r.lognormal(5, 1, 400), 1, 1024).astype(int), minlength=1025)
    placed = np.zeros(1025, np.int64)
    rooms = []  # best-fit decreasing, item by item
    for k in np.repeat(np.arange(1025), n)[::-1].tolist():
        fits = [i for i, room in enumerate(rooms) if room >= k]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= k
        else:
            rooms.append(1024 - k)
    first = packing.best_fit(n, 1024)
    for uses, times in first:
        for k, m in uses:
            placed[k] += m * times
    assert (placed == n).all() and sum(t for _, t in first) == len(rooms)
    assert sum(t for _, t in packing.plan_bins({i: int(k) for i, k in enumerate(n) if k}, 1024)) <= len(rooms)


def test_rank_coding_round_trip():
    r = np.random.default_rng(0)
    for size in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** r.uniform(0, 31.9, size)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == math.ceil(size / 4)
        assert (token_files.decode_ranks(control, data, size) == ranks).all()


def test_quality_measures():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
        seen, later = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                later += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), later, len(covered)

    r = random.Random(5)
    texts = [None, *ODD, "a\na\n a\na", "a b c d e f g h " * 3, *("".join(r.choice(["a ", "b ", "é\n", "# ", "😀\t"]) for _ in range(r.randrange(60))) for _ in range(300))]
    m = quality_rules.measure(texts, [5, 8])
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), m[8][0].tolist()))
    assert got == [brute(t) for t in texts]
    assert quality_rules.measure([], [8])["n_words"].tolist() == []


def test_shingles_and_similar_pairs():
    r = random.Random(2)
    base = [r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(120)]
    texts = []
    for k in range(40):
        words = list(base)
        for _ in range(k % 9):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["A b", "a B", "", None, "one", "one two three four five", "One two three four five six"]
    sets = dedup_near.shingle_sets(texts)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    true = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(s) for s in true]
    both = np.arange(len(sets))
    full = [s for s in both if len(sets[s])]
    found = {tuple(sorted(p)) for p in dedup_near.similar_pairs(sets, np.array(full), np.array(full)).tolist()}
    want = {(a, b) for a, b in itertools.combinations(full, 2) if 100 * len(true[a] & true[b]) >= 75 * len(true[a] | true[b])}
    assert found == want


def alternating(n, letters="ab"):
    """The Thue-Morse word of n letters and its mirror: sums of letter times power collide on them modulo 2**64."""
    word = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[i] for i in word), "".join(letters[1 - i] for i in word)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_collide_under_sums_of_powers(name):
    from tokenizers import Tokenizer

    texts = [t for n in (1024, 2048, 4096) for t in alternating(n)]
    n, ids = pretokens.BatchEncoder(P.path(name)).encode(texts)
    begin = np.cumsum(n) - n
    want = Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)
    assert [ids[b : b + k].tolist() for b, k in zip(begin, n)] == [w.ids for w in want]


@pytest.mark.parametrize("n", [16, 1024, 2048, 4096])
def test_colliding_words_and_lines_are_told_apart(n):
    a, b = alternating(n)
    one, two, three = dedup_near.shingle_sets([a, b, f"x y {a} z q r"])
    assert one.tolist() != two.tolist() and len(three) == 2
    m = quality_rules.measure([f"{a}\n{b}\n{a}", f"{a}\n{b}"], [8])
    assert m["n_dup_lines"].tolist() == [1, 0]
    spaced = [" ".join(x) for x in alternating(n)]
    assert quality_rules.measure(["\n".join(spaced)], [8])["n_dup_lines"].tolist() == [0]


def test_hashed_runs_depend_on_bytes_and_length_alone():
    from larkspur.llm.bytewords import hashed_runs

    r = random.Random(1)
    runs = [bytes(r.randrange(2) for _ in range(k)) for k in range(1, 140) for _ in range(20)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array(list(map(len, runs)))
    starts = np.cumsum(sizes) - sizes
    got = hashed_runs(data, starts, sizes)
    order = np.random.default_rng(0).permutation(len(runs))
    again = np.frombuffer(b"".join(runs[i] for i in order), np.uint8)
    moved = hashed_runs(again, np.cumsum(sizes[order]) - sizes[order], sizes[order])
    assert (moved == got[order]).all() and len(set(got.tolist())) == len(set(runs))


def test_files_of_other_layouts_are_refused(tmp_path):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match="layout"):
            pretokens.MergeTable(str(path))
    with pytest.raises(ValueError, match="sentencepiece"):
        pretokens.MergeTable(P.path("piece_bpe_32k.model"))


def test_long_texts_without_spaces_are_cut_between_words_and_marks(monkeypatch):
    monkeypatch.setattr(pretokens, "UNIT_CHARS", 30)
    r = random.Random(2)
    texts = ["".join(r.choice(["word", "can't", "12", "漢字", "。", ".", "--", "'ll", "\n"]) for _ in range(400))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        from tokenizers import Tokenizer

        assert len(pretokens._cut(texts[0])) > 10
        want = Tokenizer.from_file(P.path(name)).encode(texts[0], add_special_tokens=False).ids
        assert pretokens.BatchEncoder(P.path(name)).encode(texts)[1].tolist() == want


def colliding_words(n):
    """Pairs of different 16-byte words with one hash under hashed_runs' chain."""
    from larkspur.llm.bytewords import PRIME, hashed_runs, mixed

    r = np.random.default_rng(7)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    begin = mixed(np.array([16], np.uint64) * PRIME)
    out = []
    while len(out) < n:
        a1, a2, b1 = (letters[r.integers(0, len(letters), (400_000, 8))].copy() for _ in range(3))
        s1, s2 = (mixed(begin ^ a.view("<u8").ravel()) for a in (a1, a2))
        b2 = (s1 ^ s2 ^ b1.view("<u8").ravel()).view(np.uint8).reshape(-1, 8)
        fit = ((b2 > 32) & (b2 < 127) & ~((b2 >= 65) & (b2 <= 90))).all(1) & (a1 != a2).any(1)
        out += [(bytes(x) + bytes(y), bytes(z) + bytes(w)) for x, y, z, w in zip(a1[fit], b1[fit], a2[fit], b2[fit])]
    data = np.frombuffer(b"".join(x + y for x, y in out[:n]), np.uint8)
    h = hashed_runs(data, np.arange(2 * n) * 16, np.full(2 * n, 16))
    assert (h[::2] == h[1::2]).all()
    return [(x.decode(), y.decode()) for x, y in out[:n]]


def test_words_that_share_a_hash_stay_apart():
    pairs = colliding_words(1000)
    seven = "one two three four five six seven"
    m = quality_rules.measure(["\n".join(w for p in pairs for w in p), *(f"{a} {seven} {b} {seven}" for a, b in pairs)], [8])
    assert m["n_dup_lines"].sum() == 0 and m[8][0].sum() == 0
    for a, b in pairs[:200]:
        x, y = dedup_near.shingle_sets([f"{a} {seven}", f"{b} {seven}"])
        assert x.tolist() != y.tolist()
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        texts = [w for p in pairs for w in p] + ["璸林一倀 瀘辤吪嚪", "瀘辤吪嚪"]
        want = [w.ids for w in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        n, ids = pretokens.BatchEncoder(P.path(name)).encode(texts)
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_results_do_not_depend_on_the_hash(monkeypatch):
    from larkspur.llm import bytewords

    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "ab", "x" * 90, "y" * 90]) for _ in range(60)) + "\nline one\nline two\nline one" for _ in range(8)] + random_texts(40)
    rules = quality_rules.measure(texts, [5, 8])
    counts = pretokens.BatchEncoder(P.path("word_bpe_49k.json")).counts(texts)
    monkeypatch.setattr(bytewords, "hashed_runs", lambda data, starts, sizes: (sizes % 2).astype(np.uint64))
    monkeypatch.setattr(bytewords, "mixed", lambda x: x % np.uint64(3))
    weak = quality_rules.measure(texts, [5, 8])
    assert all((rules[k] == weak[k]).all() for k in rules)
    assert (pretokens.BatchEncoder(P.path("word_bpe_49k.json")).counts(texts) == counts).all()


def test_rules_verdict_against_plain_loops():
    r = random.Random(9)
    rules = quality_rules.Rules()
    texts = []
    for _ in range(150):
        words = [r.choice(["alpha", "be", "gamma", "é€", "#tag", "<b>"]) + (str(r.randrange(40)) if r.random() < 0.8 else "") for _ in range(r.randrange(5, 90))]
        if r.random() < 0.5:
            words += words[: r.randrange(1, 25)]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        if r.random() < 0.3:
            lines += lines[:2]
        texts.append("\n".join(lines))
    windows = sorted({rules.base_window, *rules.windows})
    m = quality_rules.measure(texts, windows)
    space = r"[^\x20\x09-\x0D]+"
    for i, t in enumerate(texts):
        words = re.findall(space, t)
        for k in windows:
            grams = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
            inside = {j + d for j, g in enumerate(grams) if grams.count(g) > 1 for d in range(k)}
            assert m[k][:, i].tolist() == [len(inside), sum(len(words[j]) for j in inside)]
        seen, again, chars = set(), 0, 0
        for line in t.split("\n"):
            if re.search(space, line):
                again += line in seen
                chars += sum(map(len, re.findall(space, line))) if line in seen else 0
                seen.add(line)
        assert (m["n_dup_lines"][i], m["dup_line_chars"][i]) == (again, chars)
        assert m["n_symbols"][i] == len(re.findall(r"[#*$%&|<>]", t)) and m["word_chars"][i] == sum(map(len, words))
