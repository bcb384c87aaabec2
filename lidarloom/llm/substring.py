"""Operator 6: substring deduplication by sliding sentence spans.

A text is cut into sentences: at line ends and after ``.``, ``!`` or ``?`` before white space. A sentence of more than
``PIECE`` words is cut on, by its words alone: of every ``WINDOW`` words on end, in any script, the one with the least
hash (the last of equals) ends a piece. Whether a word does depends on ``WINDOW`` - 1 words on either side only, so the
same passage falls into the same pieces wherever it stands. From every sentence on, the shortest run of at least ``RUN``
sentences and ``WORDS`` words is hashed; upper and lower case and white space don't count. All runs meet by hash. The
first occurrence is the one in the least document (by id, then by text hash), at the least place. Every sentence that
a later occurrence covers is removed, with the white space after it; what stays of a text stays as it was.

With these settings a passage of over 50 words holds at least one whole run, whatever stands around it. Of its words 0 to
50, cuts after words 7 to 43 are the same everywhere. If its first sentence end comes within 12 words, pieces agree from
there, else from a cut after one of the words 7 to 14: a run starts at word 15 or before. Its 20th word is word 34 or
before. If the sentence in which the passage ends starts at word 34 or before, it has over 12 words of the passage alone,
so it is cut after one of the words 34 to 41 at the latest; else its start ends the run.

The runs are written down once, a row each, and shuffled once, by hash. Of equal runs in a batch of texts all but the first
are known to occur before, whatever other batches hold, so they are not shuffled: a hash that very many documents share
has a row for each batch at most.

Rows that agree in id and text (128 bits of its hash) are one document, and keep their rows; rows with the same id, or
with none, and different texts are different documents, in the order of the input. A null id sorts first. Null text
stays null; texts with fewer words than a run are never changed. Extra columns pass through ``deduplicate`` unchanged.
Its own two columns are ``n_removed`` and ``removed``, with underscores added if ``docs`` has columns of these names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarloom.llm.common import alone, free, materialize, resident, small_batches, text_key

RUN, WORDS, PIECE, WINDOW = 2, 20, 12, 8
END = re.compile(r"[.!?]+\s+|\n+\s*")
#: A word as ``bytes.split`` has it, with the white space around it that is not another's.
WORD = re.compile(r"[\t-\r ]*+[^\t-\r ]++[\t-\r ]*+")


def cuts(words: list[bytes]) -> np.ndarray:
    """Which words are the least by hash, the last of equals, of any ``WINDOW`` words on end."""
    n = len(words)
    out = np.zeros(n, bool)
    if n >= WINDOW:
        key = (np.fromiter(map(zlib.crc32, words), np.int64, n) << 31) - np.arange(n)
        least = np.minimum(key[1:], key[:-1])
        least = np.minimum(least[2:], least[:-2])
        least = np.minimum(least[4:], least[:-4])
        out[-least & 0x7FFFFFFF] = True
    return out


def sentences(text: str, places: bool = True) -> tuple[list[int], list[bytes], list[int]]:
    """Starts (and a last end; none without ``places``), normalised sentences, and words of each."""
    starts, normal, words = [], [], []
    bounds = [m.end() for m in END.finditer(text)]
    if not bounds or bounds[-1] < len(text):
        bounds.append(len(text))
    at, every, sizes = 0, [], []
    for end in bounds:
        own = text[at:end].lower().encode().split()
        every += own
        sizes.append(len(own))
        at = end
    after = (np.flatnonzero(cuts(every)) + 1).tolist() if max(sizes) > PIECE else []
    at = first = k = 0
    for end, size in zip(bounds, sizes, strict=True):
        stop = first + size
        while k < len(after) and after[k] <= first:
            k += 1
        inner = [first]
        while k < len(after) and after[k] < stop:
            inner.append(after[k])
            k += 1
        if size <= PIECE:
            inner = [first]
        if places:
            starts.append(at)
            if len(inner) > 1:
                ends = [m.end() for m in WORD.finditer(text, at, end)]
                starts += [ends[x - first - 1] for x in inner[1:]]
        for a, b in zip(inner, [*inner[1:], stop], strict=True):
            normal.append(b" ".join(every[a:b]))
            words.append(b - a)
        first, at = stop, end
    starts.append(len(text))
    return starts, normal, words


def runs(normal: list[bytes], words: list[int], run: int = RUN, least: int = WORDS) -> Iterator[tuple[int, int]]:
    """(first sentence, number of sentences) of the shortest sufficient run from each sentence that is not empty."""
    stop = total = 0
    n = len(words)
    filled = 0
    for i in range(n):
        while stop < n and (filled < run or total < least):
            total += words[stop]
            filled += words[stop] > 0
            stop += 1
        if filled < run or total < least:
            return
        if words[i]:
            yield i, stop - i
        total -= words[i]
        filled -= words[i] > 0


SPANS = "h long, g int, doc_id long, row long, at int, t1 long, t2 long, known array<int>"


def spans(docs: DataFrame, run: int = RUN, least: int = WORDS) -> DataFrame:
    """(h, g, doc_id, row, at, t1, t2, known): the runs of every text, and a row for each text that has any. h and g are
    96 bits of a run's hash, row numbers the texts in the order of the input, at is the run's first sentence. Of equal runs
    of a batch only the first has a row; the others occur before for certain, and stand as known with their text, whose
    own hash is t1 and t2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        resident("spans", dict)
        row = TaskContext.get().partitionId() << 32
        for b in batches:
            digests, whose, at = [], [], []
            digest = xxhash.xxh3_128_digest
            for r, text in enumerate(b.column(3).to_pylist()):
                if not text:
                    continue
                _, normal, words = sentences(text, places=False)
                before = len(at)
                for i, n in runs(normal, words, run, least):
                    digests.append(digest(b" ".join(normal[i : i + n])))
                    at.append(i)
                whose += [r] * (len(at) - before)
            take, at = np.array(whose, np.int64), np.array(at, np.int32)
            found = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            h, g = found[:, 1], (found[:, 0] >> 32).astype(np.int32)
            first = firsts(h, g, places(b.column(0))[take])
            own, later = np.unique(take), take[~first]
            ends = np.cumsum(np.bincount(later, minlength=b.num_rows)[own])
            known = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(at[~first]))
            ids = lambda of, b=b: b.column(0).take(pa.array(of))
            for columns in (
                [h[first], g[first], ids(take[first]), row + take[first], at[first], None, None, None],
                [None, None, ids(own), row + own, None, b.column(1).take(pa.array(own)), b.column(2).take(pa.array(own)), known],
            ):
                n = len(columns[2])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)
            row += b.num_rows

    t1, t2 = text_key(F.col("text"))
    return small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(work, SPANS)


NAMES = [c.split()[0] for c in SPANS.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]


def places(ids: pa.Array) -> np.ndarray:
    """The place of each row of a batch by its id, null first, then by its number."""
    out = np.empty(len(ids), np.int64)
    out[np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
    return out


def firsts(h: np.ndarray, g: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the hashes are the first of equals by ``place``, then by their own order."""
    by = np.lexsort((place, g, h))
    out = np.ones(len(h), bool)
    out[by[1:]] = (h[by[1:]] != h[by[:-1]]) | (g[by[1:]] != g[by[:-1]])
    return out


def covered(docs: DataFrame, run: int = RUN, least: int = WORDS) -> DataFrame:
    """(doc_id, t1, t2, cover): per document, the first sentences of the runs that occur elsewhere before."""
    every = materialize(spans(docs, run, least))
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("doc_id", "row", "at"))
    later = every.where("h is not null").select("h", "g", "doc_id", "row", "at").withColumn("place", place).where("place > 1")
    cover = later.groupBy("row").agg(F.collect_list("at").alias("cover"))
    # of rows that agree in id and text, the first speaks for all
    rows = every.where("t1 is not null").groupBy("doc_id", "t1", "t2").agg(F.min(F.struct("row", "known")).alias("m")).select("doc_id", "t1", "t2", "m.*")
    both = rows.join(cover, "row", "left").select("doc_id", "t1", "t2", F.concat("known", F.coalesce("cover", F.array().cast("array<int>"))).alias("cover"))
    return both.where(F.size("cover") > 0)


def deduplicate(docs: DataFrame, run: int = RUN, least: int = WORDS) -> DataFrame:
    """``docs`` with the repeated sentences taken out of ``text``, and n_removed (sentences) and removed (the code
    point ranges ``start:end`` taken out, comma-joined) added."""
    base, count, which = docs, free(docs, "n_removed"), free(docs, "removed")
    names = [free(docs, n) for n in ("its_id", "its_t1", "its_t2", "its_cover")]
    found = alone(lambda: covered(docs, run, least)).toDF(*names)
    t1, t2 = text_key(F.col("text"))
    joined = base.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (t1 == F.col(names[1])) & (t2 == F.col(names[2])), "left").drop(*names[:3])
    schema = T.StructType([*base.schema.fields, T.StructField(count, T.IntegerType()), T.StructField(which, T.StringType())])
    where = base.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, ranges = b.column(where).to_pylist(), [0] * b.num_rows, [""] * b.num_rows
            for r, cover in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not cover:
                    continue
                text = texts[r]
                starts, normal, words = sentences(text)
                length = dict(runs(normal, words, run, least))
                out = sorted({i for x in cover for i in range(x, x + length[x])})
                taken: list[list[int]] = []
                for i in out:
                    if taken and taken[-1][1] == starts[i]:
                        taken[-1][1] = starts[i + 1]
                    else:
                        taken.append([starts[i], starts[i + 1]])
                gone[r] = sum(bool(normal[i]) for i in out)
                ranges[r] = ",".join(f"{s}:{e}" for s, e in taken)
                keep, at = [], 0
                for s, e in taken:
                    keep.append(text[at:s])
                    at = e
                texts[r] = "".join([*keep, text[at:]])
            columns = list(b.columns[:-1])
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32()), pa.array(ranges, pa.string())], [*b.schema.names[:-1], count, which])

    return joined.mapInArrow(work, schema)
