"""Operator 2, best-fit packing: bin completion branch-and-bound.

What has to be packed is known by its length alone, and there are at most `capacity` lengths. So Spark
counts the pieces of each length, the search runs over that histogram (at most `capacity` numbers,
whatever the number of documents) and gives fillings with multiplicities, and Spark deals the pieces
out to them by their rank among pieces of equal length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import mapped_text, new_name, saved, ship

#: A filling: (length, how often it is used) from the longest on, and how many sequences are filled so.
Filling = tuple[tuple[tuple[int, int], ...], int]
#: Waste that a search takes for equal.
EASES = (0, 1, 2, 4, 8, 16, 32, 64)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents' ids with end_id behind them, cut into pieces of capacity ids where they are longer.

    One row per piece: the kept columns, piece (from 0), start (ids before it in its document), length,
    ids (little-endian unsigned 32-bit). In a cut document the first piece takes what is over, so all
    others are full. A null or empty text is the end id alone. Input columns named like an output column
    are replaced; repeated rows are cut each for itself.
    """

    def work():
        from .pretokens import encoder

        enc = encoder(tokenizer_path)

        def fn(texts):
            sizes, ids = enc.encode(texts)
            total = sizes + 1
            flat = np.full(int(total.sum()), end_id, "<u4")
            ends = np.zeros(len(flat), bool)
            ends[np.cumsum(total) - 1] = True
            flat[~ends] = ids
            count = -(-total // capacity)
            first = total - (count - 1) * capacity
            row = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            at = (np.cumsum(total) - total)[row] + start
            raw = flat.tobytes()
            return row, [piece.astype(np.int32), start, length, [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]]

        return fn

    return mapped_text(docs, text_col, "piece int, start long, length long, ids binary", work, keep=keep)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: by total length, and by items that can't share a bin (Martello and Toth)."""
    sizes = np.arange(capacity + 1)
    number, length = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (counts, counts * sizes))  # of at least a size
    k = np.arange(1, capacity // 2 + 1)
    half = capacity // 2 + 1
    large = number[capacity - k + 1]
    free = (number[half] - large) * capacity - (length[half] - length[capacity - k + 1])
    more = -((free - (length[k] - length[half])) // capacity)
    return int(max(-(-int(length[0]) // capacity), (number[half] + np.maximum(more, 0)).max(initial=0)))


def _spread(bits: int, width: int) -> int:
    """bits together with itself moved up by 1 to width places."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def _above(bits: int, width: int) -> int:
    """bits moved up by 1 to width places."""
    return _spread(bits << 1, width - 1) if width else 0


class _Budget:
    """Steps of the search that are left."""

    def __init__(self, steps: int):
        self.left = steps

    def spent(self, steps: int) -> bool:
        self.left -= steps
        return self.left < 0


def fillings(counts: np.ndarray, largest: int, capacity: int, most_waste: int, budget: _Budget, ease: int = 0) -> Iterator[tuple[int, dict[int, int]]]:
    """All undominated fillings around the largest item: (waste, uses). Sets are bit masks of lengths.

    Least waste comes first, but the first filling of each waste up to ease counts as equal: of these, the one
    with the fewest items comes first, which leaves small items for later.

    A filling is dominated if some of its items can be replaced by one longer than they are together, or as
    long as two or more of them, that is available and still fits: whatever packing uses the one, uses the
    other as well with those items exchanged. So also if an item can be added.
    """
    room = capacity - largest
    sizes = (np.flatnonzero(counts[: room + 1])).tolist()
    have = [min(int(counts[s]) - (s == largest), room // s) for s in sizes]
    sizes, have = [s for s, n in zip(sizes, have) if n > 0], [n for n in have if n > 0]
    mask, sums, bits = (1 << (room + 1)) - 1, [], 1  # sums[i]: what items up to sizes[i] can add up to
    for s, n in zip(sizes, have):
        step = 1
        while n > 0:
            bits |= bits << (min(step, n) * s)
            n, step = n - step, 2 * step
        bits &= mask
        sums.append(bits)
    if budget.spent(20 + len(sizes) // 8):
        return

    def exact(top: int, left: int, waste: int, one: int, several: int, unused: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Sets of items below index top that add up to left. one, several: sums of one and of more items chosen;
        unused: lengths not below top that are left over."""
        if budget.spent(1):
            return
        if not left:
            every = unused
            for s in sizes[:top]:
                every |= 1 << s
            if not (_above(one | 1, waste) | _spread(several, waste)) & every:
                yield ()
            return
        i = bisect_right(sizes, left, 0, top)
        skipped = unused
        for other in sizes[i:top]:
            skipped |= 1 << other
        while i and sums[i - 1] >> left & 1 and not budget.spent(1):
            i -= 1
            s, below = sizes[i], sums[i - 1] if i else 1
            for n in range(min(have[i], left // s), 0, -1):
                if not below >> (left - n * s) & 1:
                    continue
                singles, more = one | 1 << s, several
                for k in range(n):
                    more |= (more | one | (1 << s if k else 0)) << s
                over = skipped | (1 << s if have[i] > n else 0)
                if (_above(singles, waste) | _spread(more, waste)) & over:
                    continue  # dominated, whatever follows
                for rest in exact(i, left - n * s, waste, singles, more, over):
                    yield ((s, n), *rest)
            skipped |= 1 << s

    def uses_of(chosen: tuple[tuple[int, int], ...]) -> dict[int, int]:
        uses = {largest: 1}
        for s, n in chosen:
            uses[s] = uses.get(s, 0) + n
        return uses

    def of_waste(waste: int) -> Iterator[tuple[tuple[int, int], ...]]:
        return exact(len(sizes), room - waste, waste, 0, 0, 0) if (sums[-1] if sums else 1) >> (room - waste) & 1 else iter(())

    wastes = range(min(room, most_waste) + 1)
    eased = [(w, of_waste(w)) for w in wastes[: ease + 1]]
    firsts = [(sum(n for _, n in first), w, first) for w, sets in eased if (first := next(sets, None)) is not None]
    for _, waste, first in sorted(firsts):
        yield waste, uses_of(first)
    for waste in wastes:
        for chosen in eased[waste][1] if waste <= ease else of_waste(waste):
            yield waste, uses_of(chosen)
        if budget.left < 0:
            return


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing over counts of lengths: each item goes where it leaves least room."""
    rooms: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room left: bins by what they hold

    def put(room: int, held: tuple[tuple[int, int], ...], bins: int) -> None:
        if bins:
            at = rooms.setdefault(room, {})
            at[held] = at.get(held, 0) + bins

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            each = room // length  # a bin that has taken one is the tightest for the next
            for held, bins in rooms.pop(room).items():
                full = min(bins, left // each)
                rest = min(left - full * each, each - 1) if full < bins else 0
                put(room - each * length, (*held, (length, each)), full)
                if rest:
                    put(room - rest * length, (*held, (length, rest)), 1)
                put(room, held, bins - full - bool(rest))
                left -= full * each + rest
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    return [x for room in rooms.values() for x in room.items()]


def plan_bins(histogram: Mapping[int, int], capacity: int, most_steps: int = 2_000_000) -> list[Filling]:
    """Fillings for all items of a histogram {length: count}, in as few bins as the search finds.

    Best-fit decreasing is the first incumbent. Then, depth first: around the largest item left, the undominated
    fillings are tried, least waste first, each as often as its items last and then less often. A branch is
    given up once its waste, or the lower bound of what is left, can't lead below the incumbent. The search is
    run with each of EASES (see fillings), most_steps steps in all; a step is a few microseconds, a node takes
    20 or more. The packing is the least possible if a search ends by itself or meets the lower bound, and
    otherwise the best found.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] += n
    bound = least_bins(counts, capacity)
    best = best_fit(counts, capacity)
    for ease in EASES:
        if sum(times for _, times in best) == bound:
            break
        best, ended = _completed(counts, capacity, best, bound, ease, _Budget(most_steps // len(EASES)))
        if ended:
            break
    return best


def _completed(counts: np.ndarray, capacity: int, best: list[Filling], bound: int, ease: int, budget: _Budget) -> tuple[list[Filling], bool]:
    """The best packing of one search, or the incumbent it was given; and whether nothing is left to search."""
    best_bins, total = sum(times for _, times in best), int((counts * np.arange(capacity + 1)).sum())
    whole = True

    def choices(counts: np.ndarray, waste: int) -> Iterator[tuple[int, dict[int, int], int]]:
        """(waste, uses, times) below a node; the generator's bound is that of the incumbent when it is made."""
        nonlocal whole
        largest = int(np.flatnonzero(counts)[-1])
        again = []
        for gap, uses in fillings(counts, largest, capacity, (best_bins - 1) * capacity - total - waste, budget, ease):
            most = min(int(counts[k]) // n for k, n in uses.items())
            yield gap, uses, most
            if most > 1:
                whole &= len(again) < 1000
                again += [(gap, uses, most)] if len(again) < 1000 else []
        for gap, uses, most in again:
            for times in range(most - 1, 0, -1):
                yield gap, uses, times

    stack = [[counts, 0, 0, None, None]]  # counts, bins, waste, choices, chosen filling
    while stack and best_bins > bound and budget.left >= 0:
        counts, bins, waste, options, _ = node = stack[-1]
        if options is None:
            if not counts.any():
                if bins < best_bins:
                    best, best_bins = [x[4] for x in stack[:-1]], bins
                stack.pop()
                continue
            if bins + least_bins(counts, capacity) >= best_bins:
                stack.pop()
                continue
            options = node[3] = choices(counts, waste)
        gap, uses, times = next(options, (0, None, 0))
        if uses is None or budget.spent(1):
            stack.pop()
            continue
        # below the incumbent, all bins but the last may waste this much together
        if waste + gap * times > (best_bins - 1) * capacity - total:
            continue
        node[4] = (tuple(sorted(uses.items(), reverse=True)), times)
        after = counts.copy()
        for k, n in uses.items():
            after[k] -= n * times
        stack.append([after, bins + times, waste + gap * times, None, None])
    return best, whole and budget.left >= 0


def _segments(plan: list[Filling]) -> tuple[np.ndarray, ...]:
    """By length and rank: (key length << 40 | first rank, first bin, uses, offset of the first), sorted by key."""
    ranks: dict[int, int] = {}
    rows, bins = [], 0
    for uses, times in plan:
        offset = 0
        for length, n in uses:
            begin = ranks.get(length, 0)
            rows.append((length << 40 | begin, bins, n, offset))
            ranks[length] = begin + n * times
            offset += length * n
        bins += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length", rows_per_group: int = 100_000) -> DataFrame:
    """pieces with sequence_id (0, 1, ...) and offset: each sequence holds pieces of at most capacity in all, gapless.

    Every row is placed, repeated ones too. A null length or one outside 1..capacity raises an error. Other
    columns pass through; input columns named sequence_id or offset are replaced. The rows are written to
    the shared folder once, since they are read for the histogram and again to be placed.
    """
    spark = pieces.sparkSession
    ship(spark)
    pieces = pieces.select(*(c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")))
    rid = new_name(pieces, "row_no")
    kept = saved(pieces.withColumn(rid, F.monotonically_increasing_id()))
    size = F.col(length_col).cast("long")
    histogram = {r[0]: r[1] for r in kept.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most capacity rows, else an error follows
    if None in histogram:
        raise ValueError(f"{length_col} is null in {histogram[None]} rows")
    total = sum(histogram.values())
    segments = _segments(plan_bins(histogram, capacity))

    # Rank among equal lengths without one task per length: ranks inside groups of rows, after the groups before.
    groups = max(64, -(-total // rows_per_group))
    group, rank = new_name(kept, "group_no"), new_name(kept, "rank_no")
    dealt = kept.withColumn(group, F.pmod(F.xxhash64(F.col(rid)), F.lit(groups)))
    of_length, of_group, before = (new_name(dealt, c) for c in ("of_length", "of_group", "rows_before"))
    ahead = Window.partitionBy(of_length).orderBy(of_group).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy(size.alias(of_length), F.col(group).alias(of_group)).agg(F.count(F.lit(1)).alias(before))
    counted = counted.select(of_length, of_group, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(size, group).orderBy(rid)) - 1)
    ranked = ranked.join(counted, (size == F.col(of_length)) & (F.col(group) == F.col(of_group)))
    ranked = ranked.select(*pieces.columns, (F.col(rank) + F.col(before)).alias(rank))

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow, columns = to_arrow_schema(schema), pieces.columns

    def place(batches):
        import pyarrow as pa

        begin, first_bin, uses, offset = segments
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            nth = batch.column(rank).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(begin, length << 40 | nth, side="right") - 1
            local = nth - (begin[at] & ((1 << 40) - 1))
            new = [pa.array(first_bin[at] + local // uses[at]), pa.array(offset[at] + local % uses[at] * length)]
            old = [batch.column(c).cast(arrow.field(i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*old, *new], schema=arrow)

    return ranked.mapInArrow(place, schema)
