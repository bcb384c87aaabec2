"""Operator 10: SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is read as three segments of 22, 21 and 21 bits. The perfect binary Golay code (23, 12) decodes
any segment to the one codeword within three bits, a 12-bit index. Call near(s) the indices of s and of s with any one
bit flipped: one index if s lies within two bits of its codeword, about six otherwise.

Pigeonhole: of four differing bits in three segments, the two segments with the fewest errors hold at most two
together: (0, up to 2) or (1, 1). The key set of a pair of segments (i, j) is {index(i)} x near(j) and
near(i) x {index(j)}. Two fingerprints with errors (0, up to 2) share index(i) and an index in near(j), by the segment
half way between. With (1, 1), index(i) of the first is in near(i) of the second, index(j) of the second in near(j) of
the first, so both sets hold (index(i) of the first, index(j) of the second). Hence every pair at four bits or fewer
meets under some key: about 29 keys a fingerprint, 24 bits each, no pair lost.

Equal fingerprints are one class before any key is made, so copies cost nothing. Rows that meet under a key are
verified by their true distance; only a spanning forest of each bucket leaves it, never all pairs.

Null text counts as empty: fingerprint zero, linked like any other. Texts of fewer words than a shingle are one
shingle. Repeated rows keep their rows; rows with a null id get a fingerprint, and their component is the least id
that they reach (null if there is none). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import alone, connected_components, free, materialize, resident, small_batches, with_least

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: The Golay code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1: a fixed value.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of up to so many rows are compared by shifted arrays, larger ones by a search that drops what it has linked.
SHIFTED = 24


def fingerprints_of(text: str, size: int = SHINGLE) -> int:
    """The SimHash of one text."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: lower() changes A-Z only, split() cuts at 0x20, 0x09 to 0x0D
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[size : size + n] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        block = hashes[at : at + 65_536].astype("<u8", copy=False)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > n).astype(object)).sum()) if (2 * ones > n).any() else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("simhash", Golay)
        for b in batches:
            fps = np.fromiter((fingerprints_of(t or "", size) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Decoding of 23-bit words to the 12-bit index of the codeword within three bits."""

    def __init__(self) -> None:
        m = np.arange(4096, dtype=np.int64)
        rest = m << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        self.parity = rest  # of each message
        self.errors = np.zeros(2048, np.int64)
        flips = [0] + [1 << i for i in range(23)]
        for e in {a | b | c for a in flips for b in flips for c in flips}:
            self.errors[(e & 2047) ^ self.parity[e >> 11]] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[(words & 2047) ^ self.parity[words >> 11]]) >> 11


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint."""
    own, near = [], []
    for start, bits in SEGMENTS:
        seg = (fps >> np.uint64(start)).astype(np.int64) & ((1 << bits) - 1)
        flips = np.array([0] + [1 << i for i in range(bits)], np.int64)
        all_ = np.sort(golay.index(seg[:, None] ^ flips[None, :]), axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        own.append(golay.index(seg))
        near.append(all_)
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for a, b, shift in ((i, j, (12, 0)), (j, i, (0, 12))):
            r, c = np.nonzero((near[b] >= 0) & ((near[b] != own[b][:, None]) | (a == i)))
            rows.append(r)
            keys.append(pair << 24 | own[a][r] << shift[0] | near[b][r, c] << shift[1])
    return np.concatenate(rows), np.concatenate(keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """A union-find over the fingerprints of one task; ``link`` tells whether the link was new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(keys: np.ndarray, fps: np.ndarray, most: int, forest: Forest) -> list[tuple[int, int]]:
    """A spanning forest of the links within whole buckets; ``keys`` is sorted."""
    out: list[tuple[int, int]] = []
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    longest = int(sizes[sizes <= SHIFTED].max(initial=1))
    for k in range(1, longest):
        near = np.flatnonzero((keys[k:] == keys[:-k]) & (popcount(fps[k:] ^ fps[:-k]) <= most))
        for a, b in zip(fps[near].tolist(), fps[near + k].tolist(), strict=True):
            if forest.link(a, b):
                out.append((a, b))
    for at in np.flatnonzero(sizes > SHIFTED):
        left = fps[bounds[at] : bounds[at + 1]]
        while len(left):  # each row found is compared once with what nobody has reached yet
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = popcount(left ^ x) <= most
                if hit.any():
                    queue += list(left[hit])
                    for y in left[hit].tolist():
                        if forest.link(int(x), y):
                            out.append((int(x), y))
                    left = left[~hit]
    return out


def linked(classes: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(a, b) fingerprints at ``most`` (4 at most) bits or fewer: enough links to connect all that are connected."""
    if not 0 <= most <= DISTANCE:
        raise ValueError("the keys hold for four bits or fewer")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = resident("simhash", Golay)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 4096):
                rows, keys = keys_of(part := fps[at : at + 4096], golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows].view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        keys, fps = np.empty(0, np.int32), np.empty(0, np.uint64)

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole:
                yield rows(links(keys[:whole], fps[:whole], most, forest))
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield rows(links(keys, fps, most, forest))

    met = classes.select("fp").mapInArrow(spread, "key int, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(meet, "a long, b long")


def components(marks: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of ``marks(doc_id, fp)``."""
    classes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(linked(classes, most))
    named = classes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = with_least(materialize(named), "root", F.col("first"), "component_id").select("fp", "component_id")
    return marks.join(materialize(named), "fp")  # of plain shuffles: a hot fingerprint's partition can be split


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``."""
    return alone(lambda: components(materialize(fingerprints(docs, size)), most)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near copies at a given similarity of their shingle sets ------------------------------------------------------

#: Sampled fingerprints of a text, shingles in each, and bins of the sketch that chooses what is verified.
SAMPLES, SAMPLED, BINS = 10, 4, 120
#: Over five standard errors of the sketch's estimate at a similarity of 0.8: what it turns away is unlike.
SLACK = 0.2
#: Rows that meet under one key, and shingles of a group, that one task takes; larger ones are dealt into cells, and
#: every two cells meet.
BUCKET, WEIGHT = 16_384, 2_000_000


def shingles_of(text: str, size: int = 5) -> tuple[int, np.ndarray]:
    """(64 bits of the words' hash, sorted distinct hashes of the shingles; of all words if they are fewer) of one text."""
    import xxhash

    words = text.encode().lower().split()
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        digest = xxhash.xxh64_intdigest
        hashes = np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[size : size + n] - 1).tolist(), strict=True)], np.uint64))
    return xxhash.xxh64_intdigest(joined, 1), hashes


def sketch_of(text: str, size: int = 5) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(64 bits of the words' hash, number of distinct shingles, sampled SimHash fingerprints, sketch) of one text.

    A whole text's SimHash moves by about ten bits at a Jaccard similarity of 0.8, too far for keys. The shingles are
    therefore also dealt by hash to ``SAMPLES`` classes, and each class's ``SAMPLED`` least hashes get a SimHash of
    their own: two texts of similarity s agree in any one of them with a chance of about s ** SAMPLED. The sketch
    has the least hash of each of ``BINS`` bins (16 bits; 0 where the bin is empty): the share of agreeing bins among
    those filled on either side estimates the similarity without bias.
    """
    node, hashes = shingles_of(text, size)
    n = len(hashes)
    bins = (hashes % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((hashes, bins))
    hashes, bins = hashes[order], bins[order]
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    sketch = np.zeros(BINS, np.uint16)
    sketch[bins[first]] = (hashes[first] >> np.uint64(40)).astype(np.uint16) | np.uint16(1)
    fps = np.zeros(SAMPLES, np.uint64)
    classes = bins // (BINS // SAMPLES)
    for g in np.unique(classes).tolist():
        own = np.sort(hashes[classes == g])[:SAMPLED]
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        fps[g] = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0]
    return node, n, fps, sketch


def alike(sketches: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of ``sketches`` with ``x``."""
    filled = ((sketches > 0) | (x > 0)).sum(1)
    return ((sketches == x) & (x > 0)).sum(1) / np.maximum(filled, 1)


def same(sets: list[np.ndarray], left: np.ndarray, x: int, similarity: float) -> np.ndarray:
    """Whether the shingle sets of the rows ``left`` have a Jaccard similarity of ``similarity`` or more with that of ``x``."""
    own = sets[x]
    sizes = np.array([len(sets[y]) for y in left.tolist()])
    every = np.concatenate([sets[y] for y in left.tolist()])
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    shared = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return shared >= similarity * (len(own) + sizes - shared) - 1e-9


def spanning(buckets: np.ndarray, nodes: np.ndarray, near: Callable[[np.ndarray, int], np.ndarray], forest: Forest) -> pa.RecordBatch:
    """A spanning forest of the links within whole buckets (``buckets`` is sorted): ``near`` tells which rows link to one."""
    out = []
    bounds = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True])))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        left = np.arange(a, b)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = near(left, x)
                for y in left[hit].tolist():
                    queue.append(y)
                    if forest.link(int(nodes[x]), int(nodes[y])):
                        out.append((int(nodes[x]), int(nodes[y])))
                left = left[~hit]
    both = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def in_cells(rows: DataFrame, key: str) -> DataFrame:
    """``rows(key, node, cells, ...)`` with their ``bucket``, sorted by it: the key where there is one cell, else each
    pair of cells that a row's own cell is in, so that any two rows of a key meet in some bucket."""
    own, other = F.pmod(F.xxhash64("node"), F.col("cells")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    dealt = rows.withColumn("own_cell", own).withColumn("other_cell", other)
    bucket = F.when(F.col("cells") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("own_cell", "other_cell"), F.greatest("own_cell", "other_cell")))
    return dealt.withColumn("bucket", bucket).drop("own_cell", "other_cell", "cells", key).repartition("bucket").sortWithinPartitions("bucket", "node")


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, mark, group_id, group_mark): every row's group of near copies by its first row, the least id and mark
    (mark: 64-bit hash of the text). Texts with the same words are one class; classes link at ``similarity`` or more.

    The keys of a sampled fingerprint are its three segments' Golay indices together, 36 bits. What meets under a key
    and is alike by sketch, with much in favour of linking, forms loose groups; links are pairs within a loose group
    whose whole shingle sets are as similar as asked. Only spanning forests leave a task. Null text counts as empty;
    texts without words are one class.
    """
    schema = "doc_id long, mark long, node long, n int, keys array<long>, sketch binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = resident("simhash", Golay)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [sketch_of(t or "", size) for t in part.column(2).to_pylist()]
                nodes = np.array([x for x, _, _, _ in found], np.uint64).view(np.int64)
                fps = np.stack([f for _, _, f, _ in found])
                key = np.zeros(fps.shape, np.int64)
                for start, bits in SEGMENTS:
                    key = key << 12 | golay.index((fps >> np.uint64(start)).astype(np.int64) & ((1 << bits) - 1))
                key |= np.arange(SAMPLES) << 40
                keys = [k[f > 0].tolist() for k, f in zip(key, fps, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array([n for _, n, _, _ in found], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for _, _, _, s in found], pa.binary())], ["doc_id", "mark", "node", "n", "keys", "sketch"])

    marked = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = materialize(marked.mapInArrow(mark, schema))
    # equal classes have equal keys and sketches: one row each, that of its first document
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "mark", "n", "keys", "sketch")).alias("first"))
    classes = materialize(first.select("node", "first.*"))
    keyed = classes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key", F.ceil(F.col("rows") / BUCKET).alias("cells"))
    met = in_cells(keyed.join(shared, "key").join(classes.select("node", "sketch"), "node"), "key")

    def sketches_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning forests of what is alike by sketch."""
        forest = Forest()
        buckets, nodes, sketches = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BINS), np.uint16)

        def linked_in(stop: int) -> pa.RecordBatch:
            return spanning(buckets[:stop], nodes, lambda left, x: alike(sketches[left], sketches[x]) >= similarity - SLACK, forest)

        for b in batches:
            buckets = np.concatenate((buckets, b.column(0).to_numpy()))
            nodes = np.concatenate((nodes, b.column(1).to_numpy()))
            sketches = np.concatenate((sketches, sketches_of(b.column(2))))
            whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0
            if whole:
                yield linked_in(whole)
                buckets, nodes, sketches = buckets[whole:], nodes[whole:], sketches[whole:]
        if len(buckets):
            yield linked_in(len(buckets))

    loose = connected_components(met.select("bucket", "node", "sketch").mapInArrow(meet, "a long, b long")).withColumnRenamed("component", "loose")
    members = loose.join(classes.select("node", "n", F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "sketch"), "node")
    cells = members.groupBy("loose").agg(F.ceil(F.sum("n") / WEIGHT).alias("cells"))
    members = members.join(cells, "loose").select("loose", "node", "cells", "sketch", "its_id", "its_mark")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingles_of(t or "", size)[1].tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], ["loose", "node", "cells", "sketch", "shingles"])

    texts = marked.join(members, marked["doc_id"].eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))).select("loose", "node", "cells", "sketch", "text")
    whole_sets = in_cells(texts.mapInArrow(shingle, "loose long, node long, cells long, sketch binary, shingles binary").dropDuplicates(["node"]), "loose")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning forests of what is alike by whole shingle sets."""
        forest = Forest()
        buckets, nodes, sketches, sets = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BINS), np.uint16), []

        def near(left: np.ndarray, x: int) -> np.ndarray:
            hit = alike(sketches[left], sketches[x]) >= similarity - SLACK
            if hit.any():
                hit[hit] = same(sets, left[hit], x, similarity)
            return hit

        for b in batches:
            buckets = np.concatenate((buckets, b.column(0).to_numpy()))
            nodes = np.concatenate((nodes, b.column(1).to_numpy()))
            sketches = np.concatenate((sketches, sketches_of(b.column(2))))
            sets += [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()]
            whole = int(np.searchsorted(buckets, buckets[-1])) if len(buckets) else 0
            if whole:
                yield spanning(buckets[:whole], nodes, near, forest)
                buckets, nodes, sketches, sets = buckets[whole:], nodes[whole:], sketches[whole:], sets[whole:]
        if len(buckets):
            yield spanning(buckets, nodes, near, forest)

    found = connected_components(whole_sets.select("bucket", "node", "sketch", "shingles").mapInArrow(verify, "a long, b long"))
    named = materialize(classes.select("node", F.struct("doc_id", "mark").alias("first")).join(found, "node", "left").withColumn("root", F.coalesce("component", "node")))
    groups = materialize(with_least(named, "root", F.col("first"), "group").select("node", "group"))
    return rows.select("doc_id", "mark", "node").join(groups, "node").select("doc_id", "mark", F.col("group.doc_id").alias("group_id"), F.col("group.mark").alias("group_mark"))


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the one with the least id (null first), then the least mark; exactly
    repeated rows of it are one row."""
    its_id, its_mark = free(docs, "its_id"), free(docs, "its_mark")
    first = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("mark") == F.col("group_mark"))
    kept = alone(lambda: similar(docs, size, similarity).where(first).select(F.col("doc_id").alias(its_id), F.col("mark").alias(its_mark)).distinct())
    joined = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(its_id)) & (F.xxhash64(docs["text"]) == F.col(its_mark)), "left_semi")
    return joined.dropDuplicates(["doc_id", "text"])
