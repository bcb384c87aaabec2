"""Operator 5: token counts by a map-side two-tier lookup.

Texts are cut into pre-tokens where they lie. The token length of a pre-token comes from a compact table of frequent
pre-tokens, broadcast to all tasks, or else from the tokenizer through the worker's own bounded cache. No pre-token is
ever shuffled. Byte-level BPE encodes every pre-token by itself, so the sum of lengths is exact; the table decides
speed only, never a count.

The table is filled from a bounded sample of documents (``TABLE_DOCS``, those with the least hashed ids) in one task
and holds at most ``TABLE_SIZE`` pre-tokens of at most ``TABLE_CHARS`` characters, some MB at any input size.

Null text counts as empty (0 bytes, 0 tokens). Texts are never cut short. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.bpe import BYTES
from lidarloom.llm.common import resident, sample_texts, small_batches

TABLE_DOCS, TABLE_SIZE, TABLE_CHARS, CACHE = 2_000, 40_000, 40, 200_000
#: The byte-level pre-tokenizer's pattern, with the white space of its regex engine spelled out: fixed values.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    """Token lengths of pre-tokens: the broadcast table first, then the worker's cache, then the tokenizer."""

    def __init__(self, path: str, table: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.pre = regex.compile(PATTERN).findall
        specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.table, self.cache = table, {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens between them."""
        if self.at_special is None or not self.at_special.search(text):
            return self.pre(text), 0
        parts = self.at_special.split(text)
        return [p for part in parts for p in self.pre(part)], len(parts) - 1

    def count(self, text: str) -> int:
        tokens, n = self.pretokens(text)
        get, cache = self.table.get, self.cache
        misses = []
        for t in tokens:
            k = get(t)
            if k is None:
                misses.append(t)
            else:
                n += k
        if len(cache) > CACHE:  # frequent pre-tokens came early: the later half goes
            for t in list(islice(cache, CACHE // 2, None)):
                del cache[t]
        new = list({t for t in misses if t not in cache})
        if new:
            tokenize = self.tok.model.tokenize
            for t in new:
                cache[t] = len(tokenize(t.encode().decode("latin-1").translate(BYTES)))
        return n + sum(map(cache.__getitem__, misses))


def counted_for(path: str, table: dict[str, int]) -> Counted:
    """The worker's own counter, kept from task to task with what its cache has learned."""
    found = resident(("counted", path), lambda: Counted(path, table))
    found.table = table
    return found


def frequent_table(docs: DataFrame, path: str, n_docs: int = TABLE_DOCS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of a bounded sample of documents."""
    sample = sample_texts(docs, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen = Counted(path, {}), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(x for x in counted.pretokens(t or "")[0] if len(x) <= TABLE_CHARS)
        top = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
        lengths = [len(e.ids) for e in counted.tok.encode_batch_fast(top, add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(lengths, pa.int32())], ["t", "n"])

    return {r.t: r.n for r in sample.coalesce(1).mapInArrow(run, "t string, n int").collect()}


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text."""
    path = path or default_path()
    small_batches(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = counted_for(path, table.value)
        for b in batches:
            counts = pa.array([counted.count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(docs["doc_id"].cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
