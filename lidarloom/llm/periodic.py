"""Operator 13: runs of repeating words (maximal repetitions) by a harmonic grid of common extensions.

A run of period p and length 2p or more covers two neighbouring places jp and (j+1)p of the grid of step p. For each
period of a text and each pair of neighbours, the longest common extensions forwards and backwards therefore tell the
whole run, and the grids of all periods have n ln n pairs together. Extensions are least values of the LCP array between
two ranks of the suffix array (of the reversed array for backward ones), answered by a sparse table. Pairs of unlike
words have an extension of 0 and are not asked for.

Suffix arrays are sorted by prefix doubling over many texts at once, the text's number first, with only those places
sorted again whose rank is shared. Texts never meet: every task works on its own rows, nothing is shuffled. A task holds
some 200,000 words, or one text if that is longer; memory is in proportion to the words of a text times the logarithm of
their number.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text counts as empty and has no words and no runs. Repeated
rows give repeated results, null ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import free, small_batches

#: Least length of a run in words; words that a task works on at once; grid pairs that are asked for at once.
LEAST, WORDS, PAIRS = 12, 200_000, 2_000_000
WORD = r"[^\x20\x09-\x0D]+"


class Suffixes:
    """Suffix array, ranks and LCP array of concatenated texts: ``code`` are words, ``stop`` each place's text end."""

    def __init__(self, code: np.ndarray, text: np.ndarray, stop: np.ndarray):
        n = len(code)
        key = text.astype(np.int64) * (int(code.max(initial=0)) + 1) + code
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = heads(key[order])
        levels, width = [rank], 1
        shared = np.bincount(rank, minlength=n)[rank] > 1
        active = np.flatnonzero(shared)
        while len(active):
            ahead = active + width
            second = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)], -1)
            own = rank[active].astype(np.int64)
            both = own * (n + 1) + second + 1
            order = np.argsort(both, kind="stable")
            own, both, active = own[order], both[order], active[order]
            rank = rank.copy()
            rank[active] = own + heads(both) - heads(own)
            levels.append(rank)
            active = active[np.bincount(rank[active], minlength=n)[rank[active]] > 1]
            width *= 2
        self.rank = rank
        at = np.empty(n, np.int64)
        at[rank] = np.arange(n)
        low, high, self.lcp = at[:-1].copy(), at[1:].copy(), np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = (low < n) & (high < n)
            same[same] = levels[k][low[same]] == levels[k][high[same]]
            self.lcp[1:][same] += 1 << k
            low[same] += 1 << k
            high[same] += 1 << k
        self.table = [self.lcp]
        longest = int((stop - np.arange(n)).max(initial=1))
        while 2 << (len(self.table) - 1) <= longest:
            half, before = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(before[: len(before) - half], before[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, for different places of one text each."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level):
            own = level == k
            t = self.table[k]
            out[own] = np.minimum(t[low[own]], t[high[own] - (1 << int(k))])
        return out


def heads(values: np.ndarray) -> np.ndarray:
    """For sorted values, the place of the first equal one."""
    first = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))


def grids(size: np.ndarray, begin: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): the grid places jp that have a neighbour (j+1)p in their text, for all periods up to half the
    text's words, in portions of about ``most``."""
    half = size // 2
    text = np.repeat(np.arange(len(size)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    each = (size[text] - 1) // period
    total = np.cumsum(each)
    start = 0
    while start < len(text):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        n, p = each[start:end], period[start:end]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, b = np.repeat(p, n), np.repeat(begin[text[start:end]], n)
        yield b + j * p, p
        start = end


def find_runs(code: np.ndarray, size: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the concatenated texts of ``size`` words, by text, start and
    period; starts count from the text's first word."""
    n, begin = len(code), np.cumsum(size) - size
    if not n:
        return np.zeros((0, 4), np.int64)
    text = np.repeat(np.arange(len(size)), size)
    stop, back_stop = np.repeat(begin + size, size), n - np.repeat(begin, size)[::-1]
    forward = Suffixes(code, text, stop)
    backward = Suffixes(code[::-1], text[::-1], back_stop)
    found = []
    for a, p in grids(size, begin):
        b = a + p
        like = code[a] == code[b]
        a, b, p = a[like], b[like], p[like]
        after = forward.extension(a, b)
        before = np.zeros(len(a), np.int32)
        inner = np.flatnonzero(a > begin[text[a]])
        inner = inner[code[a[inner] - 1] == code[b[inner] - 1]]
        before[inner] = backward.extension(n - a[inner], n - b[inner])
        start, end = a - before, b + after
        keep = end - start >= np.maximum(least, 2 * p)
        found.append(np.stack((start[keep], end[keep], p[keep]), 1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # a stretch of several periods has the least of them
        runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))]
    own = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    out = np.stack((own, runs[:, 0] - begin[own], runs[:, 1] - runs[:, 0], runs[:, 2]), 1) if len(runs) else np.zeros((0, 4), np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def solved(words: list[list[str]], least: int) -> tuple[list[list[dict]], list[str]]:
    """The runs of each text, and each text without the words that only repeat a run's period."""
    size = np.array([len(w) for w in words], np.int64)
    flat = pa.array([w for own in words for w in own], pa.string())
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    runs: list[list[dict]] = [[] for _ in words]
    for t, s, n, p in find_runs(code, size, least).tolist():
        runs[t].append({"start": s, "length": n, "period": p})
    out = []
    for own, found in zip(words, runs, strict=True):
        if found:
            drop = np.zeros(len(own) + 1, np.int64)
            for r in found:
                drop[r["start"] + r["period"]] += 1
                drop[r["start"] + r["length"]] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        out.append(" ".join(own))
    return runs, out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the words
    outside the repeated parts of runs joined by one space. Where ``docs`` has columns so called, the new ones have
    underscores added to their names."""
    names = free(docs, "runs"), free(docs, "collapsed")
    find = re.compile(WORD).findall
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [find(t or "") for t in b.column(at).to_pylist()]
            start, held = 0, 0
            for i, w in enumerate(words):
                held += len(w)
                if held >= WORDS or i + 1 == len(words):
                    runs, texts = solved(words[start : i + 1], least)
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, RUNS), pa.array(texts, pa.string())], [*part.schema.names, *names])
                    start, held = i + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return small_batches(docs).mapInArrow(work, f"{schema}, `{names[0]}` array<struct<start: long, length: long, period: long>>, `{names[1]}` string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as the contract's query wants it: every tenth document, by the checksum h of its id, goes
    on repeating a stretch of its own words from a place on. A null id plants nothing."""
    c = F.col
    h = F.crc32(c("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    d = d.withColumn("n", F.size("words")).withColumn("a", F.when(c("n") > 0, c("g") % c("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((c("n") - c("a")) / (3 + c("g") % 8))).cast("int"))
    left = c("n") - c("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", c("a") + 1, c("p")), F.ceil(left / c("p")).cast("int"))), F.lit(1), left)
    return d.select("doc_id", F.when(c("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), c("a")), again), " ")).otherwise(c("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of every document's runs after ``planted``; see the registered query."""
    c = F.col
    r = periodic_runs(planted(docs.select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    r = r.withColumn("best", best)
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-c("best.start")).alias("start"), c("best.length").alias("length"), (-c("best.period")).alias("period"),
        F.floor(1000 * c("best.length") / -c("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(c("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
