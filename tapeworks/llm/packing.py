"""Best-fit packing: pieces of at most `capacity` tokens into as few sequences as can be found.

Only the lengths matter for the plan, and there are at most `capacity` of them: the histogram of
lengths is counted in Spark and a plan of patterns (a filling and how often it is used) is made from it
by bin completion. The largest length left is completed by the first `WIDTH` undominated fillings, least waste first;
a branch is cut when its waste rules out beating the incumbent, which starts as best-fit decreasing;
the search ends at the lower bound or after `nodes` steps, with the best plan so far. Pieces then take
their places by rank among equal lengths, counted per bucket, so no length meets in one task.

Cases: a null or empty text is its end token alone. A document of more than `capacity` tokens is cut
into full pieces after a first one with the remainder. Rows that share a doc_id, or equal rows, are
packed as often as they come. An empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import group_of, parts, written
from .tokens import default_path, encoder

CAPACITY, END = 1024, 2
#: Search steps, fillings tried at a step, and partial fillings looked at for them.
NODES, WIDTH, LOOKS = 8_000, 4, 500
_PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit) of every piece."""
    path, tail = path or default_path(), np.array([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, ids in enumerate(encoder(path).rows(b["text"])):
                ids, step = ids + tail, 4 * capacity
                lo, hi, n = 0, len(ids) % step or step, 0
                while lo < len(ids):
                    rows.append((k, n, lo // 4, (hi - lo) // 4, zlib.crc32(ids[lo:hi]), ids[lo:hi] if with_ids else None))
                    lo, hi, n = hi, hi + step, n + 1
            k, n, start, length, crc, own = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([
                b["doc_id"].take(pa.array(k, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own, pa.binary()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}, ids binary")
    return out if with_ids else out.drop("ids")


def _greedy(left: dict[int, int], room: int) -> tuple[int, ...]:
    """Best fit: again and again the largest length that fits."""
    out, used = [], {}
    for n in sorted(left, reverse=True):
        while n <= room and used.get(n, 0) < left[n]:
            out.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
    return tuple(out)


def _dominated(chosen: tuple[tuple[int, int], ...], slack: int, free: int, left: dict[int, int]) -> bool:
    """Whether a length in `free`, or one chosen that is left over, can take the place of some chosen ones at no more than `slack` in addition."""

    def sums(but: int = 0) -> int:
        out, wide = 1, 1
        for n, m in chosen:
            for _ in range(m if n != but else 0):
                out |= out << n
        while wide <= slack:
            step = min(wide, slack + 1 - wide)
            out, wide = out | out << step, wide + step
        return out

    return bool(sums() & free) or any(left[n] > m and sums(n) >> n & 1 for n, m in chosen)


def fillings(left: dict[int, int], room: int, most_waste: int, looks: int = LOOKS) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` by any number of lengths, least waste first, then largest lengths first.

    A filling is dominated if a length left over can stand for some of its lengths (or for none) within the
    room: what it holds would fit in their places elsewhere. Totals that the lengths from some place on reach, each
    as often as it is left, are bits of one number. `looks` bounds the partial fillings tried.
    """
    lengths = sorted((n for n in left if n <= room), reverse=True)
    within, reach = (1 << (room + 1)) - 1, [1]
    for n in reversed(lengths):
        bits, copies, step = reach[-1], min(left[n], room // n), 1
        while copies:
            step = min(step, copies)
            bits |= bits << n * step
            copies, step = copies - step, 2 * step
        reach.append(bits & within)
    reach.reverse()
    every = sum(1 << n for n in lengths)

    def build(goal: int, at: int, chosen: tuple[tuple[int, int], ...], slack: int, free: int) -> Iterator[tuple[int, ...]]:
        nonlocal looks
        looks -= 1
        spare = free | sum(1 << n for n, m in chosen if left[n] > m)
        if not goal:
            if not _dominated(chosen, slack, free, left):
                yield tuple(n for n, m in chosen for _ in range(m))
            return
        single = spare & (((1 << (slack + 1)) - 1) << goal)  # one length in place of all that is still to come
        if single:
            if single == 1 << goal and free >> goal & 1 and at < len(lengths) and goal <= lengths[at]:
                yield from build(0, at, (*chosen, (goal, 1)), slack, free & ~(1 << goal))
            return
        while at < len(lengths) and reach[at] >> goal & 1 and looks > 0:
            n = lengths[at]
            at += 1
            for m in range(min(left[n], goal // n), 0, -1):
                if looks > 0 and reach[at] >> (goal - m * n) & 1:
                    more = (*chosen, (n, m))
                    rest = free & ~(1 << n)
                    if not _dominated(more, slack, rest >> n << n, left):
                        yield from build(goal - m * n, at, more, slack, rest)

    totals = reach[0]
    while totals and looks > 0:
        goal = totals.bit_length() - 1
        totals ^= 1 << goal
        if room - goal > most_waste or lengths and goal < lengths[0]:
            return
        yield from build(goal, 0, (), room - goal, every)


def _lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: lengths above half need bins of their own."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in {0, *(n for n in counts if 2 * n <= capacity)}:
        big = sum(c for n, c in counts.items() if n > capacity - k)
        half = sum(c for n, c in counts.items() if capacity - k >= n and 2 * n > capacity)
        room = half * capacity - sum(n * c for n, c in counts.items() if capacity - k >= n and 2 * n > capacity)
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        best = max(best, big + half + max(0, -(-(small - room) // capacity)))
    return best


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    left, out = dict(counts), []
    while left:
        out.append((f := _greedy(left, capacity), _use(left, f)))
    return out


def _use(left: dict[int, int], filling: tuple[int, ...]) -> int:
    """Take a filling as often as the lengths last."""
    times = min(left[n] // filling.count(n) for n in set(filling))
    for n in set(filling):
        left[n] -= times * filling.count(n)
        if not left[n]:
            del left[n]
    return times


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that use every piece once, by bin completion."""
    counts = {n: c for n, c in counts.items() if c}
    best = _best_fit(counts, capacity)
    bins, bound, total = sum(t for _, t in best), _lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    stack = [(counts, None, (), 0, 0)]  # lengths left, (steps before, filling, times), the filling to take, bins, waste
    while stack and nodes > 0 and bins > bound:
        left, steps, filling, used, waste = stack.pop()
        nodes -= 1
        if filling:
            left = dict(left)
            times = _use(left, filling)
            steps, used, waste = (steps, filling, times), used + times, waste + times * (capacity - sum(filling))
        spare = (bins - 1) * capacity - total - waste  # waste that a better plan may still have
        if spare < 0:
            continue
        if not left:
            best, bins = [], used
            while steps:
                steps, filling, times = steps
                best.append((filling, times))
            continue
        large = max(left)
        rest = {n: c - (n == large) for n, c in left.items() if c > (n == large)}
        options = list(islice(fillings(rest, capacity - large, min(spare, capacity - large)), width))
        greedy = _greedy(rest, capacity - large)
        if greedy not in options and (capacity - large - sum(greedy)) <= spare and not (options and options[0] == (capacity - large,)):
            options.append(greedy)
        options.sort(key=lambda f: (sum(f), -len(f)))
        stack += [(left, steps, (large, *f), used, waste) for f in options]
    return best


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in the pattern, first sequence, offset) sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for filling, times in patterns:
        offset = 0
        for n in sorted(set(filling), reverse=True):
            m = filling.count(n)
            rows.append((n, taken.get(n, 0), m, sequence, offset))
            taken[n] = taken.get(n, 0) + m * times
            offset += m * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(made: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """`made` (from `pieces`) with sequence_id and offset; it is read twice, so give a written table."""
    lengths = made.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # at most `capacity` rows
    places = _places(plan(counts, capacity, nodes))
    buckets = parts(sum(counts.values()), 1 << 18, 16)
    dealt = made.withColumn("bucket", group_of(buckets, F.col("doc_id"), F.col("piece")))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own")).select(*made.columns, "rank")
    kind = made.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places[:, 0] << 48) + places[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            n, first, m, sequence, offset = places[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in kind.names] + [pa.array(sequence + (rank - first) // m), pa.array(offset + (rank - first) % m * n)], [*kind.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(written(pieces(docs, capacity, end, path, with_ids), "pieces"), capacity)
