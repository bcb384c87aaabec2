"""Operator 3: BPE encoding and decoding by tree concatenation.

A text of more than ``LONG`` code points is cut, wherever that falls, in leaves of ``LEAF``, which are rows of their own:
Spark deals them out and encodes them in parallel. A leaf sends on the ids of its inner words, and its first and last
words as they stand. Each join of two leaves is then repaired: a window of one word on either side, or two, or four ...
is encoded again until its outermost words and their tokens are those that both sides have (``join``). A leaf without
enough white space to hold such words becomes part of the window as a whole. Shorter texts are encoded where they lie.

White space is a boundary that no token crosses (the tokenizer drops it), so in ordinary text the window ends at the
words around the cut. Within a long run without white space it grows by tokens: the run's pieces of ``RUN`` characters
are encoded by themselves, and halves are joined pair by pair (``join_runs``). Words and pre-tokens met before come from
the worker's own bounded caches.

Why agreement is exact: a token sequence is the BPE encoding of its text if and only if every two neighbouring
tokens are the encoding of their own concatenation. Once a window shares one token with each side, every neighbouring
pair of the spliced sequence stood side by side in some true encoding.

Null text counts as empty; an empty text has no ids and decodes to the empty string. Repeated rows give repeated
results. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import resident, small_batches

#: Code points of a leaf and of a text that is encoded where it lies, words on either end of a leaf that joins may take
#: in, code points of a run that is encoded as one, entries of a worker's cache.
LEAF, LONG, EDGE, RUN, CACHE = 16_384, 32_768, 4, 64, 320_000
#: What the tokenizer's ``\\s`` matches; ``str.split()`` also cuts at U+001C to U+001F, which ``\\s`` doesn't match.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT, ODD = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str]:
    if ODD.search(text):
        return [w for w in CUT.split(text) if w]
    return text.split()


def byte_table() -> dict[int, str]:
    """Byte-level mapping: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTES = byte_table()


#: The pre-tokenizer's pattern for lower-case ASCII without white space: a fixed value.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


class Remembered(dict):
    """A bounded memo of a function. Frequent keys come early, so the later half goes when it is full."""

    def __init__(self, make: Callable[[str], object]):
        self.make = make

    def __missing__(self, key: str) -> object:
        found = self[key] = self.make(key)
        return found

    def shrink(self) -> None:
        if len(self) > CACHE:
            for key in list(islice(self, CACHE // 2, None)):
                del self[key]


class TreeEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, for a word-level BPE."""

    def __init__(self, path: str, render: Callable[[Sequence[int], list[str]], object]):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        starts = {t[:2] for t in self.special}  # a word without this holds no special token
        self.mark = starts.pop() if len(starts) == 1 else ""
        self.vocabulary = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.pieces = Remembered(self.tokenize)
        self.cache = Remembered(lambda word: render(self.encode_word(word), self.vocabulary))

    def tokenize(self, mapped: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.tok.model.tokenize(mapped)])

    # -- runs without white space ------------------------------------------------------------------------------

    def bpe(self, piece: str) -> list[tuple[int, int]]:
        """(id, end) of the tokens of a mapped pre-token; its last character carries the end-of-word mark."""
        return [(t.id, t.offsets[1]) for t in self.tok.model.tokenize(piece)]

    def encode_run(self, piece: str) -> list[tuple[int, int]]:
        """Tree concatenation of a pre-token of any length. Offsets are characters of the mapped string. The last
        tokens of a part, touched by the end-of-word mark, are provisional and get replaced by the join."""
        if len(piece) <= RUN:
            return self.in_chars(piece)
        parts = [self.in_chars(piece[i : i + RUN]) for i in range(0, len(piece), RUN)]
        starts = list(range(0, len(piece), RUN))
        while len(parts) > 1:
            joined = [self.join_runs(piece, starts[k], parts[k], starts[k + 1], parts[k + 1], starts[k + 2] if k + 2 < len(starts) else len(piece)) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
            parts, starts = joined, starts[::2]
        return parts[0]

    def in_chars(self, piece: str) -> list[tuple[int, int]]:
        """Tokens with their ends in characters of ``piece`` (the model counts bytes)."""
        out, at = [], 0
        raw = piece.encode()
        for i, end in self.bpe(piece):
            at = len(raw[:end].decode()) if len(raw) != len(piece) else end
            out.append((i, at))
        return out

    def join_runs(self, piece: str, start: int, left: list, cut: int, right: list, stop: int) -> list[tuple[int, int]]:
        """Tokens of piece[start:stop] from those of piece[start:cut] and piece[cut:stop], ends counted from each start."""
        lends, rends = {e + start: k for k, (_, e) in enumerate(left)}, {e + cut: k for k, (_, e) in enumerate(right)}
        reach = 16
        while True:
            a, b = max(start, cut - reach), min(stop, cut + reach)
            # a window starts where a token of the left side starts, so that a shared first token is a shared pair
            a = max([start] + [e for e in lends if e <= a]) if a > start else start
            window = self.in_chars(piece[a:b])
            ends = [(i, e + a) for i, e in window]
            head = lends.get(ends[0][1])
            agree_left = a == start or (head is not None and left[head][0] == ends[0][0] and ends[0][1] < cut)
            if agree_left and b == stop:
                keep = [(i, e) for i, e in left if e + start <= a]
                return keep + [(i, e - start) for i, e in ends]
            if agree_left:
                # the window's last tokens are touched by its artificial end; any earlier shared token will do
                for k in range(len(ends) - 2, 0, -1):
                    i, e = ends[k]
                    r = rends.get(e)
                    before = ends[k - 1][1]
                    if r is not None and before >= cut and right[r][0] == i and (right[r - 1][1] + cut if r else cut) == before and e < stop:
                        keep = [(j, x) for j, x in left if x + start <= a]
                        middle = [(j, x - start) for j, x in ends[: k + 1]]
                        return keep + middle + [(j, x + cut - start) for j, x in right[r + 1 :]]
            reach *= 2

    def encode_word(self, word: str) -> Sequence[int]:
        """A run without white space, cut at special tokens and pre-tokens first."""
        plain = self.mark not in word if self.mark else not self.special
        if plain and word.isascii() and word.isprintable():
            if word.isalpha():
                return self.encode_piece(word.lower())
            return [i for piece in PLAIN(word.lower()) for i in self.encode_piece(piece)]
        # a letter may become a letter and a mark in lower case, and Sigma's depends on its place in Python only
        if plain and "\u03a3" not in word and (low := word.lower()).isalpha() and is_normalized("NFC", word):
            return self.encode_piece(low.encode().decode("latin-1").translate(BYTES))
        ids: list[int] = []
        for piece in self.at_special.split(word) if self.at_special else [word]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece)):
                    ids += self.encode_piece(mapped)
        return ids

    def encode_piece(self, mapped: str) -> Sequence[int]:
        """Ids of a mapped pre-token."""
        return self.pieces[mapped] if len(mapped) <= RUN else [i for i, _ in self.encode_run(mapped)]

    # -- texts -------------------------------------------------------------------------------------------------

    def batch(self, texts: list[str]) -> Iterator[list[object]]:
        """For each text, what ``render`` makes of each of its words."""
        for text in texts:
            self.cache.shrink()
            self.pieces.shrink()
            yield list(map(self.cache.__getitem__, words_of(text)))


    # -- leaves of long texts ----------------------------------------------------------------------------------

    def ends_of(self, leaf: str) -> tuple[str, list[str], str] | None:
        """A leaf's first ``EDGE`` words, its inner ones and its last ``EDGE``, the outer ones as they stand; nothing if
        it has fewer. The first and the last of all may go on in the next leaf."""
        places = [m.span() for m in NOT_SPACE.finditer(leaf)]
        if len(places) <= 2 * EDGE:
            return None
        return leaf[: places[EDGE - 1][1]], words_of(leaf[places[EDGE - 1][1] : places[-EDGE][0]]), leaf[places[-EDGE][0] :]

    def join(self, left: str, right: str) -> list[object]:
        """What ``render`` makes of the words of ``left`` and ``right`` side by side: of both sides' own words but for
        a window around the cut, which grows until its outermost words are theirs."""
        own, its, of = words_of(left), words_of(right), self.cache.__getitem__
        reach = 1
        while reach <= min(len(own), len(its)):
            window = words_of(left[starts_of(left)[-reach] :] + right[: stops_of(right)[reach - 1]])
            if len(window) > 1 and of(window[0]) == of(own[-reach]) and of(window[-1]) == of(its[reach - 1]) and (window[0], window[-1]) == (own[-reach], its[reach - 1]):
                return list(map(of, [*own[:-reach], *window, *its[reach:]]))
            reach *= 2
        return list(map(of, words_of(left + right)))


NOT_SPACE = re.compile(f"[^{SPACE}]+")


def starts_of(text: str) -> list[int]:
    return [m.start() for m in NOT_SPACE.finditer(text)]


def stops_of(text: str) -> list[int]:
    return [m.end() for m in NOT_SPACE.finditer(text)]


def coder_for(path: str, render: Callable[[Sequence[int], list[str]], object]) -> TreeEncoder:
    """The worker's own encoder: a worker runs many tasks, and what it has learned serves them all."""
    return resident((path, render.__name__), lambda: TreeEncoder(path, render))


def as_text(ids: Sequence[int], vocabulary: list[str]) -> tuple[str, str, int]:
    return " ".join(map(str, ids)), " ".join([vocabulary[i] for i in ids]), len(ids)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Digest:
    """Number of tokens, and the digests of the ids and of the tokens joined by single spaces, as words come."""

    def __init__(self) -> None:
        self.n, self.ids, self.tokens = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: str, tokens: str, n: int) -> None:
        if n:
            gap = " " if self.n else ""
            self.ids.update((gap + ids).encode())
            self.tokens.update((gap + tokens).encode())
            self.n += n


def joined_up(found: Sequence[tuple[str, str, int]]) -> tuple[str, str, int]:
    """The words' parts as one."""
    found = [x for x in found if x[2]]
    ids, tokens, counts = zip(*found, strict=True) if found else ((), (), ())
    return " ".join(ids), " ".join(tokens), sum(counts)


def encode_decode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; the decoded text is the tokens joined by spaces,
    as the library decodes for a file without a decoder."""
    path = path or default_path()
    small_batches(docs)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def result(ids: pa.Array, found: list[Digest]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([d.n for d in found], pa.int64()), pa.array([d.ids.hexdigest() for d in found], pa.string()), pa.array([d.tokens.hexdigest() for d in found], pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, as_text)
        for b in batches:
            out = []
            for found in coder.batch([t or "" for t in b.column(1).to_pylist()]):
                out.append(Digest())
                out[-1].add(*joined_up(found))
            yield result(b.column(0), out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, row, text in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                starts = range(0, len(text), leaf)
                for x in range(0, len(starts), 64):
                    some = starts[x : x + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([row.as_py()] * n, pa.int64()), pa.array(range(x, x + n), pa.int32()), pa.array([text[s : s + leaf] for s in some], pa.string())], ["doc_id", "row", "k", "leaf"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(path, as_text)
        for b in batches:
            rows = []
            for text in b.column(3).to_pylist():
                ends = coder.ends_of(text)
                coder.cache.shrink()
                head, inner, tail = ends or (text, [], None)
                rows.append((head, tail, *joined_up([coder.cache[w] for w in inner])))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "row", "k", "head", "tail", "ids", "tokens", "n"])

    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves come by text and place; what is not yet joined of the last one waits."""
        coder = coder_for(path, as_text)
        at, doc_id, digest, wait = None, None, None, []
        for b in batches:
            for its_id, row, _, head, tail, ids, tokens, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row != at:
                    if at is not None:
                        digest.add(*joined_up(coder.join("".join(wait), "")))
                        yield result(pa.array([doc_id], pa.int64()), [digest])
                    at, doc_id, digest, wait = row, its_id, Digest(), []
                if tail is None:  # no word of this leaf is surely whole
                    wait.append(head)
                    continue
                digest.add(*joined_up(coder.join("".join(wait), head)))
                digest.add(ids, tokens, n)
                wait = [tail]
        if at is not None:
            digest.add(*joined_up(coder.join("".join(wait), "")))
            yield result(pa.array([doc_id], pa.int64()), [digest])

    size = F.coalesce(F.length("text"), F.lit(0))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    short = rows.where(size <= long).mapInArrow(run, OUT)
    texts = rows.where(size > long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    leaves = texts.mapInArrow(cut, "doc_id long, row long, k int, leaf string").repartition("row", "k")
    found = leaves.mapInArrow(encode, "doc_id long, row long, k int, head string, tail string, ids string, tokens string, n long")
    return short.union(found.repartition("row").sortWithinPartitions("row", "k").mapInArrow(concatenate, OUT))
