"""Operator 9: best-fit packing of tokenised documents by a linear grouping scheme.

What decides a packing is how many pieces there are of each length, and a piece is at most ``capacity`` tokens long:
so the whole corpus is summed up exactly, without sampling, in a histogram of at most ``capacity`` counts. ``plan``
packs that histogram:

1. large lengths, in descending order, are cut into ``GROUPS`` groups of equal cardinality, and each length is rounded
   up to the largest of its group, which leaves few sizes;
2. configurations of these few sizes are optimised: the linear programme of the fewest sequences is solved by column
   generation (a knapsack finds the configuration that the programme's prices favour most, until none pays), and each
   configuration is used as often as the solution's whole part says;
3. what the whole parts leave over, a few pieces of each size, is filled by the fullest configurations one after the
   other;
4. the actual lengths take the places of the rounded ones, and in a sequence's last place the largest that fits;
5. small lengths go best-fit, in descending order, into the smallest gap that holds them, or into new sequences.

The plan is a list of runs: (length, first rank, count, first sequence, offset). Spark ranks the pieces of each length
(counts per task, summed up over tasks, plus the rank within the task), and each piece looks its run up by length and
rank. The runs are bounded by ``capacity`` and the number of groups, not by the corpus; they are broadcast.

Null text counts as empty: a piece of one token, id 0. Texts are never cut short; only documents of more than
``capacity`` tokens are cut, into full pieces and a last one. Rows with the same doc_id are packed each on its own.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from struct import Struct
from struct import pack as struct_pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lidarloom.llm.bpe import coder_for, default_path
from lidarloom.llm.common import materialize, small_batches

#: Sizes that large lengths are rounded up to; lengths of at most a ``SMALL``-th of the capacity are small.
CAPACITY, GROUPS, SMALL = 2048, 64, 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


IDS = [Struct(f"<{n}I") for n in range(32)]


def as_bytes(ids: Sequence[int], _: list[str]) -> bytes:
    return IDS[len(ids)].pack(*ids) if len(ids) < len(IDS) else struct_pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document; ``local`` counts the pieces of a length within the task ``part``."""
    path = path or default_path()
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, as_bytes)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        width = 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, found in zip(b.column(0).to_pylist(), coder.batch(texts), strict=True):
                ids = b"".join(found) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Runs of equal sequences: ``n`` of them, each with the items (length, first rank) and the same gap."""

    def __init__(self, n: int, gap: int, items: list[tuple[int, int]]):
        self.n, self.gap, self.items = n, gap, items

    def split(self, n: int) -> Bins:
        """Take the first ``n`` away."""
        first = Bins(n, self.gap, list(self.items))
        self.items = [(length, rank + n) for length, rank in self.items]
        self.n -= n
        return first

    def put(self, length: int, rank: int, copies: int) -> None:
        self.items += [(length, rank + k * self.n) for k in range(copies)]
        self.gap -= copies * length


def grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """The lengths, in descending order, in groups of equal cardinality as nearly as whole lengths allow."""
    each = max(1, -(-sum(counts.values()) // groups))
    out: list[list[int]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        if room <= 0:
            out.append([])
            room = each
        out[-1].append(length)
        room -= counts[length]
    return out


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (descending) fill ``room`` best; the bounded knapsack prefers large sizes."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    took = np.full(room + 1, -1, np.int32)
    for i, size in enumerate(sizes):
        if size > room:
            continue
        for _ in range(min(counts[i], room // size)):
            new = np.zeros(room + 1, bool)
            new[size:] = reach[:-size] & ~reach[size:]
            if not new.any():
                break
            took[new] = i
            reach |= new
            if reach[room]:
                break
        if reach[room]:
            break
    use = [0] * len(sizes)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i = int(took[at])
        use[i] += 1
        at -= sizes[i]
    return use


def knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """How many of each size fill ``room`` for the most worth, any number of each."""
    best, took = np.zeros(room + 1), np.full((len(sizes), room + 1), 0, np.int32)
    for i, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if w <= 0:
            continue
        start = best.copy()
        for k in range(1, room // size + 1):  # k of this size on top of what the sizes before do
            more = start[: room + 1 - k * size] + k * w
            better = more > best[k * size :] + 1e-12
            best[k * size :][better] = more[better]
            took[i, k * size :][better] = k
    use, at = np.zeros(len(sizes), np.int64), int(best.argmax())
    for i in range(len(sizes) - 1, -1, -1):
        use[i] = took[i, at]
        at -= use[i] * sizes[i]
    return use


def configurations(sizes: list[int], counts: list[int], capacity: int, most: int = 2_000) -> list[tuple[list[int], int]]:
    """(how many of each size, times): the whole part of the linear programme's solution, by column generation: revised
    simplex steps on one basic configuration for each size, each brought in by the knapsack."""
    n = len(sizes)
    if not n:
        return []
    size, need = np.array(sizes), np.array(counts, float)
    basis = np.diag((capacity // size).astype(float))  # a column is a configuration
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)  # what a place for each size is worth
        new = knapsack(size, prices, capacity)
        if new @ prices <= 1 + 1e-9:
            break
        amount, step = inverse @ need, inverse @ new
        leave = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(leave.argmin())] = new
    times = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(np.int64)
    return [(basis[:, k].astype(int).tolist(), int(t)) for k, t in enumerate(times) if t > 0]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset) that place every piece."""
    done: list[Bins] = []
    if counts.get(capacity):
        done.append(Bins(counts[capacity], 0, [(capacity, 0)]))
    small = capacity // SMALL
    stock = {k: n for k, n in counts.items() if small < k < capacity and n}
    rank = dict.fromkeys(stock, 0)
    ready = sorted(stock)  # lengths still in stock
    large = grouped(stock, groups)
    sizes = [own[0] for own in large]
    of_group = {length: i for i, own in enumerate(large) for length in own}
    left = [sum(stock[length] for length in own) for own in large]
    bins: list[Bins] = []

    def fill(use: list[int], times: int) -> None:
        """Open ``times`` sequences of a configuration, at most, and give its places to actual lengths: the largest of
        the group, and in the last place the largest of all that fit."""
        slots = [i for i, u in enumerate(use) for _ in range(u)]
        while times:
            used: dict[int, int] = {}
            room = capacity
            for i in slots[:-1]:
                length = next((x for x in large[i] if stock[x] > used.get(x, 0)), None)
                if length is None:
                    return
                used[length] = used.get(length, 0) + 1
                room -= length
            at = bisect_right(ready, room) - 1
            while at >= 0 and stock[ready[at]] <= used.get(ready[at], 0):
                at -= 1
            if at >= 0:
                used[ready[at]] = used.get(ready[at], 0) + 1
                room -= ready[at]
            if not used:
                return
            k = min(times, *(stock[x] // u for x, u in used.items()))
            bins.append(Bins(k, room, [(x, rank[x] + j * k) for x, u in sorted(used.items(), reverse=True) for j in range(u)]))
            for x, u in used.items():
                rank[x] += u * k
                stock[x] -= u * k
                left[of_group[x]] -= u * k
                if not stock[x]:
                    ready.remove(x)
                    large[of_group[x]].remove(x)
            times -= k

    for use, times in configurations(sizes, left, capacity):
        fill(use, times)
    first = 0
    while True:
        while first < len(sizes) and not left[first]:
            first += 1
        if first == len(sizes):
            break
        left[first] -= 1
        use = fullest(sizes, left, capacity - sizes[first])
        left[first] += 1
        use[first] += 1
        fill(use, min(left[i] // u for i, u in enumerate(use) if u))
    by_gap: dict[int, list[Bins]] = {}
    for x in bins:
        by_gap.setdefault(x.gap, []).append(x)
    gaps = sorted(by_gap)
    for length in sorted((k for k, n in counts.items() if k <= small and k < capacity and n), reverse=True):
        need, at_rank = counts[length], 0
        while need:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                x = Bins(-(-need // (capacity // length)), capacity, [])
            else:
                gap = gaps[at]
                x = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            each = x.gap // length
            whole = min(x.n, need // each)
            for n, copies in ((whole, each), (1 if whole < x.n and need % each else 0, need % each)):
                if n and copies:
                    y = x.split(n) if n < x.n else x
                    y.put(length, at_rank, copies)
                    at_rank, need = at_rank + n * copies, need - n * copies
                    if y is x:
                        x = None
                    if y.gap not in by_gap:
                        insort(gaps, y.gap)
                    by_gap.setdefault(y.gap, []).append(y)
                if x is None or not need:
                    break
            if x is not None and x.n and x.items:
                if x.gap not in by_gap:
                    insort(gaps, x.gap)
                by_gap.setdefault(x.gap, []).append(x)
    done += [x for own in by_gap.values() for x in own]
    rows, sequence = [], 0
    for x in done:
        offset = 0
        for length, rank in x.items:
            rows.append((length, rank, x.n, sequence, offset))
            offset += length
        sequence += x.n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = materialize(pieces(docs, capacity, path))
    per_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity, groups))
    before = per_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = found.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = runs.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
