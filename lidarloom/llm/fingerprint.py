"""Operator 1: document fingerprints from prefix polynomial hashes.

``PrefixHashes`` keeps, for two primes, the modular sums P[k] = sum of (c_i + 1) * B^i over the first k code points.
Any span's hash is (P[j] - P[i]) * B^-i, so two spans of any two texts are compared in constant time, and the longest
common extension from two places is found by binary search.

A fingerprint is a thinned prefix array: the length, the hash of the whole text and

* at up to 32 multiples of a power of two (the smallest that leaves no more), the hashes of the prefixes and of the
  suffixes that long. Multiples of the larger of two such steps are in both fingerprints, so binary search over them
  finds the longest common prefix and suffix that they attest;
* the hashes and lengths of the spans between cuts that the text itself makes: behind windows of ``WINDOW`` code points
  whose hash ends in enough zeros. The same passage is cut alike wherever it stands. A longer text has fewer cuts for
  its length; spans of the finer of two fingerprints are put together (hashes of neighbours add up) to those of the
  coarser one.

Likeness is the larger of two shares of the longer text: what common prefix and suffix attest, and the spans that both
have, wherever they stand. It is 1 for equal texts only, and 0 where one text is empty.

Each document is held against the next one in descending doc_id. The rows are dealt into ranges of (id, hash of the
text), cut by a bounded sample of these; each text travels once, to its range, and the first of each range also to the
range before it. Within a range the texts stream by, sorted, two at a time. Rows with the same id are ordered by the
hash of their text, and may lie in several ranges; rows without an id come last. Null text counts as empty. A single
document is its own next one; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import resident, small_batches

#: Two primes below 2^31 and a base for each; checkpoints of a fingerprint on either side.
PRIMES, BASES, CHECKPOINTS = (2_147_483_647, 2_147_483_629), (1_000_003, 805_306_457), 32
LOWEST = -(1 << 63)
#: Code points of a window that may cut a text, zeros that its hash ends in at least, spans of a fingerprint at most, and
#: rows of the sample for each range.
WINDOW, ZEROS, SPANS, SAMPLE = 8, 3, 64, 32


class Powers:
    """Powers of the bases and of their inverses, grown by doubling as longer texts come."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.int64) for _ in PRIMES]
        self.down = [np.ones(1, np.int64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            k = len(self.up[0])
            for i, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
                self.up[i] = np.concatenate((self.up[i], self.up[i] * pow(b, k, p) % p))
                self.down[i] = np.concatenate((self.down[i], self.down[i] * pow(b, -k, p) % p))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class PrefixHashes:
    """Modular prefix arrays of a text. ``sums`` are not yet reduced: below 2^31 a term, exact in 64 bits."""

    def __init__(self, powers: Powers, sums: list[np.ndarray]):
        self.powers, self.sums, self.n = powers, sums, len(sums[0]) - 1

    @classmethod
    def of(cls, powers: Powers, codes: np.ndarray) -> PrefixHashes:
        return cls(powers, [np.zeros(1, np.int64) for _ in PRIMES]).then(0, codes)

    def then(self, keep: int, codes: np.ndarray) -> PrefixHashes:
        """The hashes of the first ``keep`` code points followed by ``codes``."""
        end = keep + len(codes)
        self.powers.reach(end + 1)
        sums = []
        for own, up, p in zip(self.sums, self.powers.up, PRIMES, strict=True):
            out = np.empty(end + 1, np.int64)
            out[: keep + 1] = own[: keep + 1]
            np.cumsum((codes + 1) * up[keep:end] % p, out=out[keep + 1 :])
            out[keep + 1 :] += own[keep]
            sums.append(out)
        return PrefixHashes(self.powers, sums)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, stop), wherever they stand."""
        out = np.zeros(len(start), np.int64)
        for own, down, p in zip(self.sums, self.powers.down, PRIMES, strict=True):
            out = out << 31 | (own[stop] - own[start]) % p * down[start] % p
        return out

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """The inner places behind each window, and the zeros that its hash, well mixed, ends in."""
        if self.n <= WINDOW:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own, p = self.sums[0], PRIMES[0]
        found = (own[WINDOW:-1] - own[: -WINDOW - 1]) % p * self.powers.down[0][: self.n - WINDOW] % p
        mixed = (found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        low = mixed & (~mixed + np.uint64(1))
        return np.arange(WINDOW, self.n), np.bitwise_count(low - np.uint64(1)).astype(np.int64)

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Is the span of this text at ``i`` the other's at ``j``?"""
        at = lambda x, k: int(x.spans(np.array([k]), np.array([k + length]))[0])
        return i + length <= self.n and j + length <= other.n and at(self, i) == at(other, j)

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension from ``i`` here and ``j`` there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


class Fingerprint:
    """Length, whole hash, 24 bits of the hashes of prefixes and suffixes at multiples of ``step``, and the spans (hash,
    length, zeros of the cut behind it) between cuts of ``zeros`` or more."""

    def __init__(self, h: PrefixHashes):
        n = self.n = h.n
        self.step = 1
        while n > CHECKPOINTS * self.step:
            self.step *= 2
        marks = np.arange(self.step, n + 1, self.step)
        zero = np.zeros(len(marks), np.int64)
        at, zeros = h.cuts()
        self.zeros = max(ZEROS, (n // SPANS).bit_length())
        while (inner := zeros >= self.zeros).sum() >= SPANS:
            self.zeros += 1
        at, zeros = at[inner], zeros[inner]
        starts = np.concatenate(([0], zero, n - marks, [0], at))
        stops = np.concatenate(([n], marks, zero + n, at, [n]))
        found = h.spans(starts, stops)
        k = len(marks)
        self.whole = int(found[0])
        self.prefix, self.suffix = found[1 : k + 1] & 0xFFFFFF, found[k + 1 : 2 * k + 1] & 0xFFFFFF
        self.between = list(zip(found[2 * k + 1 :].tolist(), np.diff(np.concatenate(([0], at, [n]))).tolist(), [*zeros.tolist(), 99], strict=True))

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole:016x}." + "".join(f"{x:06x}" for x in self.prefix.tolist()) + "." + "".join(f"{x:06x}" for x in self.suffix.tolist()) + f".{self.zeros:x}." + "-".join(f"{h:016x}{n:x}" for h, n, _ in self.between)

    def spans_at(self, zeros: int) -> Counter[tuple[int, int]]:
        """(hash, length) of the spans between cuts of ``zeros`` or more, put together from its own."""
        out: Counter[tuple[int, int]] = Counter()
        parts, n = [0] * len(PRIMES), 0
        for found, length, last in self.between:
            for i, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                own = found >> 31 * (len(PRIMES) - 1 - i) & 0x7FFFFFFF
                parts[i] = (parts[i] + own * pow(base, n, p)) % p if n else own
            n += length
            if last >= zeros:
                out[parts[0] << 31 | parts[1], n] += 1
                parts, n = [0] * len(PRIMES), 0
        return out

    def likeness(self, other: Fingerprint) -> float:
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        step = max(self.step, other.step)
        count = min(self.n, other.n) // step
        shared = 0
        for side in ("prefix", "suffix"):
            mine, its = getattr(self, side)[step // self.step - 1 :: step // self.step], getattr(other, side)[step // other.step - 1 :: step // other.step]
            low, high = 0, count
            while low < high:  # equal at one mark means equal at all before
                mid = (low + high + 1) // 2
                low, high = (mid, high) if mine[mid - 1] == its[mid - 1] else (low, mid - 1)
            shared += low * step
        zeros = max(self.zeros, other.zeros)
        within = self.spans_at(zeros) & other.spans_at(zeros)
        shared = max(min(shared, self.n, other.n), sum(length * times for (_, length), times in within.items()))
        longer = max(self.n, other.n)
        return shared / longer if shared < longer else longer / (longer + 1)


def in_ranges(docs: DataFrame) -> DataFrame:
    """(target, copy, k, h, doc_id, text): one partition for each range of (id descending, hash of the text); the first
    rows of a range also stand, as ``copy``, at the end of the range before (before the first range: the last one)."""
    spark = small_batches(docs).sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("h"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a bounded sample of keys, chosen by hash; it decides how even the ranges are, nothing else
    sample = sorted((-r["k"], r["h"]) for r in rows.select("k", "h").orderBy(F.xxhash64("h", "k")).limit(SAMPLE * n).collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def ranges(k: pd.Series, h: pd.Series) -> list[int]:
        return [bisect_right(cuts, (-x, y)) for x, y in zip(k.tolist(), h.tolist(), strict=True)]

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges(k, h))

    found = rows.select(range_of("k", "h").alias("range"), "k", "h").groupBy("range").agg(F.max(F.struct("k", (-1 - F.col("h")).alias("h"))).alias("head")).collect()
    heads = {r["range"]: (r["head"]["k"], -1 - r["head"]["h"]) for r in found}
    full = sorted(heads)
    before = dict(zip(full, [full[-1], *full[:-1]], strict=True)) if full else {}

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[r, -1 - before[r]] if heads[r] == key else [r] for r, key in zip(ranges(k, h), zip(k.tolist(), h.tolist(), strict=True), strict=True)])

    sent = rows.select(F.explode(targets("k", "h")).alias("t"), "k", "h", "doc_id", "text")
    sent = sent.select(F.when(F.col("t") < 0, -1 - F.col("t")).otherwise(F.col("t")).alias("target"), (F.col("t") < 0).alias("copy"), "k", "h", "doc_id", "text")
    return sent.repartitionById(len(cuts) + 1, F.col("target")).sortWithinPartitions("copy", F.desc("k"), "h", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = resident("powers", Powers)
        last = None  # the document before: id, text, hashes, fingerprint
        closed = False
        for b in batches:
            rows: list[tuple] = []
            for copy, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if closed:
                    continue  # further copies of the first id
                hashes = PrefixHashes.of(powers, code_points(text))
                mark = Fingerprint(hashes)
                if last is not None:
                    its_id, its_text, its_hashes, its_mark = last
                    n = len(its_text)
                    tail = text[: n // 3]
                    keep = n - n // 3
                    edited = Fingerprint(its_hashes.then(keep, code_points(tail)))
                    rows.append((its_id, n, hashlib.sha256((its_text[:keep] + tail).encode()).hexdigest(), str(its_mark), str(edited), its_mark.likeness(edited), its_mark.likeness(mark)))
                last = (doc_id, text, hashes, mark)
                closed = copy
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_ranges(docs).select("copy", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
