"""Operator 4: toxicity by noisy-channel deobfuscation.

A word that looks disguised (digits or symbols among its letters, letters repeated three times or more, letters spread
out one by one) becomes a lattice: each character may stand for itself, for the letters that it imitates, for nothing
(a separator), or for one of a run of repeats. Viterbi decoding under a character trigram model of the training texts
finds the likeliest plain word, a second one the likeliest words if blanks are missing too (the words of ``MIN_DOCS`` training
texts or more by their frequency, others by the trigrams); the text's words and the restored ones are scored together. A word's features are
itself and its beginnings of 3 to 6 letters; a text has each feature once, so length doesn't matter. The score is
logistic over a few selected features; a single feature that very many toxic and no clean training texts have is
proof enough by itself.

Both models are trained on all labelled rows outside the held-out fold crc32(doc_id) mod 3 = 1: Spark counts words and
features and fits the regression; the driver holds the counts of
three characters, the words of ``MIN_DOCS`` texts or more and the chosen features. Language, source and id are never inputs. Null text counts as empty; an empty text gets
the score of a text without features. Without training labels of both kinds every score is the base rate. Rows with a
repeated or null id are scored on their own (a null id is not held out). Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lidarloom.llm.common import delete, free, materialize, resident, small_batches, text_key

FEATURES, MIN_DOCS, REJECT, RIDGE, DOUBT = 1_500, 4, 0.7, 3e-4, 8
#: Features that a task counts before it hands the counts on.
HELD, GRAM = 500_000, pa.schema([("gram", pa.string()), ("n", pa.int64())])
#: What a character may imitate, besides itself: fixed values.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = set(".-_*~^'`,:;/\\#%&=\"")
EDGES = ".,;:!?\"'()[]{}<>*#%&$@|/\\~^=+-_"
DISGUISED = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d@$!|+€£¥_]|[\d@$!|+(<€£¥_][^\W\d_]|([^\W\d_])\1\1")
#: Signs behind a word that stand for no letters: exclamation marks, and any sign three times or more.
TRAIL = re.compile(r"(?:!|([^\w\s])\1\1+)+[.,;:?]*$")
#: Letters within ``BARE`` signs are disguised only if a letter stands three times in a row.
BARE, TRIPLE = ".,;:?\"'", re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
#: Words of more than ``LONGEST`` characters are decoded whole, but not remembered. A word that fewer than ``MIN_DOCS`` training texts have costs ``STRANGE`` more than its letters.
LONGEST, CACHE, STRANGE = 40, 150_000, 4.0


def grams(words: Iterable[tuple[str, int]]) -> Counter[str]:
    """How often the words, with their numbers, have each three characters, and each two before another."""
    counts: Counter[str] = Counter()
    for w, n in words:
        padded = f"^^{w}$"
        for i in range(2, len(padded)):
            counts[padded[i - 2 : i + 1]] += n
            counts[padded[i - 2 : i]] += n
    return counts


class CharModel:
    """A character trigram model with additive smoothing; ``^`` pads the start and ``$`` ends a word."""

    def __init__(self, words: dict[str, int]):
        self.set(grams(words.items()), sum(words.values()), words)

    def set(self, counts: Counter[str], every: int, words: dict[str, int]) -> None:
        """The counts of ``grams``, of all words, and the words that ``spell`` knows, with their numbers."""
        self.counts, self.every, self.words, self.sorted = counts, every, dict(words), sorted(words)
        self.size = len({g[-1] for g in counts if len(g) == 3} | {"$"})
        self.known: dict[str, float] = {}

    def below(self, node: tuple[int, int, int], char: str) -> tuple[int, int, int] | None:
        """Of the sorted words from ``node[0]`` to ``node[1]``, which agree in ``node[2]`` letters, those with ``char`` next."""
        lo, hi, n = node
        prefix = self.sorted[lo][:n] if lo < hi else ""
        lo = bisect_left(self.sorted, prefix + char, lo, hi)
        if lo == hi or not self.sorted[lo].startswith(prefix + char):
            return None
        return lo, bisect_left(self.sorted, prefix + chr(ord(char) + 1), lo, hi), n + 1

    def end(self, node: tuple[int, int, int]) -> float | None:
        """The cost of the word that ends at ``node``, if one does."""
        word = self.sorted[node[0]]
        return math.log(self.every / self.words[word]) if len(word) == node[2] else None

    def cost(self, context: str, char: str) -> float:
        key = context + char
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = -math.log((self.counts[key] + 0.05) / (self.counts[context] + 0.05 * self.size))
        return found

    def readings(self, c: str, last: str) -> tuple[list[tuple[str, float]], float | None]:
        """What a character after ``last`` may be, and what it costs to be nothing."""
        options = [(x, 0.0 if x == c else 1.0) for x in ([c] if c.isalpha() else []) + list(IMITATES.get(c, ""))]
        return options, 0.5 if c in SEPARATORS else 1.0 if c == last and c.isalpha() else 6.0 if not c.isalpha() else None

    def restore(self, word: str) -> str:
        """The likeliest plain form of a lower-case word."""
        best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}  # by the last two characters: cost, (letters before, letter)
        last = ""
        for c in word:
            nxt: dict[str, tuple[float, tuple]] = {}
            options, drop = self.readings(c, last)
            for state, (cost, text) in best.items():
                for x, paid in options:
                    total = cost + paid + self.cost(state, x)
                    key = state[1] + x
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, (text, x))
                if drop is not None and (state not in nxt or cost + drop < nxt[state][0]):
                    nxt[state] = (cost + drop, text)
            best = nxt
            last = c
        return "".join(backwards(min(((cost + self.cost(state, "$"), text) for state, (cost, text) in best.items()), key=lambda x: x[0])[1])) if best else word

    def spell(self, run: str) -> list[str]:
        """The likeliest plain words of a run of lower-case letters without blanks, of any length: as ``restore``, but
        a word may end before any letter. Words are the training texts' own or, at more cost, any letters."""
        # by the place within a word (the last two letters, or a range of known words): cost, (words and letters before, letter)
        best: dict[str | tuple[int, int, int], tuple[float, tuple]] = {}
        edge: tuple[float, tuple] = (0.0, ())  # the cheapest way to have whole words only
        top = (0, len(self.sorted), 0)
        last = ""
        for c in run:
            nxt: dict[str | tuple[int, int, int], tuple[float, tuple]] = {}
            options, drop = self.readings(c, last)
            for state, (cost, text) in [("^^", (edge[0] + STRANGE, edge[1])), (top, edge), *best.items()]:
                for x, paid in options:
                    if isinstance(state, str):
                        key, total = state[1] + x, cost + paid + self.cost(state, x)
                    elif (key := self.below(state, x)) is None:
                        continue
                    else:
                        total = cost + paid
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, (text, x))
                if drop is not None and state in best and (state not in nxt or cost + drop < nxt[state][0]):
                    nxt[state] = (cost + drop, text)
            ends = [(edge[0] + (STRANGE if drop is None else drop), edge[1])] if drop is not None or not nxt else []
            for state, (cost, text) in nxt.items():
                more = self.cost(state, "$") if isinstance(state, str) else self.end(state)
                if more is not None:
                    ends.append((cost + more, (text, " ")))
            edge = min(ends, key=lambda x: x[0])
            best, last = nxt, c
        return "".join(backwards(edge[1])).split()


def backwards(text: tuple) -> list[str]:
    """The letters of a chain (letters before, letter)."""
    out = []
    while text:
        text, x = text
        out.append(x)
    return out[::-1]


def plain(word: str) -> str:
    return word.strip(EDGES)


def features_of(word: str) -> list[str]:
    out = ["=" + word]
    for n in range(3, min(6, len(word)) + 1):
        out.append("^" + word[:n])  # noqa: PERF401
    return out


def beginnings(features: Iterable[str]) -> set[str]:
    """The first three letters of the features: a word that begins otherwise has none of them."""
    return {f[1:4] for f in features}


def vocabulary(text: str) -> set[str]:
    return {plain(w) for w in set(text.lower().split())}


class Model:
    """Logistic over features, or what a single feature proves alone if that is more."""

    def __init__(self, chars: CharModel, weights: dict[str, float], bias: float, proof: dict[str, float]):
        self.chars, self.weights, self.bias, self.proof = chars, weights, bias, proof
        self.cache: dict[str, tuple[str, ...]] = {}
        self.starts = beginnings(weights)

    def of_word(self, raw: str) -> tuple[str, ...]:
        """The scored features of a word as it stands in a lower-case text, restored forms included."""
        found = self.cache.get(raw)
        if found is None:
            bare = raw.strip(BARE)
            forms = {plain(raw)}
            if (TRIPLE.search(bare) if bare.isalpha() else DISGUISED.search(TRAIL.sub("", raw))):
                forms.add(self.chars.restore(plain(raw)))
                forms.add(self.chars.restore(raw))
                forms.update(self.chars.spell(raw))
            found = tuple(f for w in forms if w[:3] in self.starts for f in features_of(w) if f in self.weights)
            if len(raw) <= LONGEST:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                self.cache[raw] = found
        return found

    def features(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        seen = self.cache
        for w in set(low.split()):
            found = seen.get(w)
            out.update(self.of_word(w) if found is None else found)
        for m in SPACED.finditer(low):
            joined = re.sub(r"\s", "", m.group())
            out.update(f for w in {joined, self.chars.restore(joined), *self.chars.spell(joined)} for f in features_of(w) if f in self.weights)
        return out

    def score(self, text: str) -> float:
        found = self.features(text)
        z = self.bias + sum(self.weights[f] for f in found)
        return max([1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *(self.proof[f] for f in found if f in self.proof)])


def fit(rows: list[tuple[str, int]]) -> Model:
    """Select features by how much more often toxic texts have them, then fit a ridge logistic regression. Equal texts
    count once. A feature's proof is the toxic share of the texts that have it, with ``DOUBT`` clean ones assumed and
    clean ones counting four times their kind's share."""
    rows = list(dict(rows).items())
    words: Counter[str] = Counter()
    number: dict[str, int] = {}  # of each feature; texts keep numbers, not strings
    sets = []
    for text, _ in rows:
        own = vocabulary(text)
        words.update(w for w in own if w.isalpha())
        found = {number.setdefault(f, len(number)) for w in own if w for f in features_of(w)}
        sets.append(np.fromiter(found, np.int32, len(found)))
    chars = CharModel(words)
    chars.set(chars.counts, chars.every, {w: n for w, n in words.items() if n >= MIN_DOCS})
    y = np.array([t for _, t in rows], float)
    n_on, n_off = int(y.sum()), int(len(y) - y.sum())
    if not n_on or not n_off:
        return Model(chars, {}, math.log((n_on + 0.5) / (n_off + 0.5)), {})
    names, none = list(number), np.empty(0, np.int32)
    on, off = (np.bincount(np.concatenate([none, *(x for x, (_, t) in zip(sets, rows, strict=True) if bool(t) == k)]), minlength=len(names)) for k in (True, False))
    # log likelihood ratio with its sampling error taken off: rare features must be one-sided to be chosen
    ratio = np.log((on + 0.5) / (n_on + 1)) - np.log((off + 0.5) / (n_off + 1))
    sure = ratio - 2 * np.sqrt(1 / (on + 0.5) + np.where(off > 0, 1 / (off + 0.5), 0.0))
    able = np.flatnonzero((on >= MIN_DOCS) & (sure > 0.7))
    able = np.array(sorted(able.tolist(), key=lambda i: (-sure[i] * on[i], names[i]))[:FEATURES], int)
    chosen = [names[i] for i in able]
    place = np.full(len(names) + 1, -1)
    place[able] = np.arange(len(able))
    r = np.concatenate([np.empty(0, int), *(np.full((place[x] >= 0).sum(), i) for i, x in enumerate(sets))])
    c = np.concatenate([np.empty(0, int), *(p[p >= 0] for p in (place[x] for x in sets))])
    w, b = np.zeros(len(chosen)), math.log(n_on / n_off)
    weight = np.where(y > 0, 0.5 * len(y) / n_on, 0.5 * len(y) / n_off)  # both kinds count alike
    step = 4 / max(1.0, np.bincount(r, minlength=1).max(initial=1))
    v, c0, t = w.copy(), b, 1.0
    for _ in range(1_500):  # accelerated projected gradient; chosen features speak for toxicity only
        z = c0 + (np.bincount(r, v[c], len(y)) if len(chosen) else 0.0)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        new_w = np.maximum(v - 4 * step * (np.bincount(c, g[r], len(chosen)) + RIDGE * v), 0.0) if len(chosen) else v
        new_b = c0 - 4 * step * g.sum()
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, c0 = new_w + (was - 1) / t * (new_w - w), new_b + (was - 1) / t * (new_b - b)
        w, b = new_w, new_b
    kept = [i for i in range(len(chosen)) if w[i] > 1e-3]
    proof = on[able] / (on[able] + DOUBT + 4 * off[able] * n_off / n_on)
    return Model(chars, {chosen[i]: float(w[i]) for i in kept}, float(b), {chosen[i]: float(proof[i]) for i in kept if on[able[i]] > DOUBT})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows outside the held-out fold, by Spark: as ``fit`` has it, to the precision of the
    regression. Equal texts count once, with the label of the greatest id. Texts with the same chosen features and label are
    one weighted row of the regression."""
    texts = materialize(training_texts(docs, labels))
    found = materialize(texts.mapInArrow(counted, "feature string, alpha boolean, n_on long, n_off long").groupBy("feature", "alpha").agg(F.sum("n_on").alias("n_on"), F.sum("n_off").alias("n_off")))
    try:
        return modelled(texts, found)
    finally:
        delete(texts.written_to)
        delete(found.written_to)


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows outside the held-out fold, equal texts once. Which rows these are is found by ids
    and keys of texts, so a text moves once only: to its id. The join is a merge at any size, as its order is what the
    last step, one row of those with the same id and text, needs."""
    key = ["doc_id", "one", "two"]
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    one, two = text_key(F.col("text"))
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where("text is not null").where(fold(F.col("doc_id")) != 1).select("doc_id", one.alias("one"), two.alias("two"), "text")
    last = given.drop("text").join(own, "doc_id").groupBy("one", "two").agg(F.max(F.struct("doc_id", "toxic")).alias("last"))
    last = last.select("last.doc_id", "one", "two", (F.col("last.toxic") == 1).alias("toxic"))
    return given.join(last.hint("merge"), key).dropDuplicates(key).select("text", "toxic")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, whether it is a whole word of letters, toxic and clean texts that have it) of (text, toxic): summed up as
    far as ``HELD`` features go, so a feature may come more than once."""
    kinds: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    of: dict[str, list[str]] = {}

    def rows() -> pa.RecordBatch:
        names = list(kinds[0] | kinds[1])
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f[0] == "=" and f[1:].isalpha() for f in names], pa.bool_()), *(pa.array([k[f] for f in names], pa.int64()) for k in kinds[::-1])], ["feature", "alpha", "n_on", "n_off"])
        for k in kinds:
            k.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            kinds[toxic].update(set().union(*[of.get(w) or of.setdefault(w, features_of(w)) for w in vocabulary(text) if w]))
            if len(of) > CACHE:
                of.clear()
            if len(kinds[0]) + len(kinds[1]) > HELD:
                yield rows()
    yield rows()


def modelled(texts: DataFrame, found: DataFrame) -> Model:
    """The model of ``texts(text, toxic)``, whose features ``found`` has counted."""
    c = F.col
    n_on, n_off = texts.agg(F.count_if("toxic"), F.count_if(~c("toxic"))).first()
    words = found.where("alpha").select(F.substring("feature", 2, 2**31 - 1).alias("word"), (c("n_on") + c("n_off")).alias("n"))
    pieces = words.mapInArrow(lambda batches: [pa.RecordBatch.from_pydict({"gram": list(g), "n": list(g.values())}, GRAM) for g in [grams(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True))]], "gram string, n long")
    chars = CharModel({})
    chars.set(Counter(dict(pieces.groupBy("gram").agg(F.sum("n")).collect())), words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], dict(words.where(c("n") >= MIN_DOCS).collect()))
    if not n_on or not n_off:
        return Model(chars, {}, math.log((n_on + 0.5) / (n_off + 0.5)), {})
    on, off = c("n_on"), c("n_off")
    ratio = F.log((on + 0.5) / (n_on + 1)) - F.log((off + 0.5) / (n_off + 1))
    sure = ratio - 2 * F.sqrt(1 / (on + 0.5) + F.when(off > 0, 1 / (off + 0.5)).otherwise(0.0))
    able = found.where(on >= MIN_DOCS).withColumn("sure", sure).where("sure > 0.7").orderBy((c("sure") * on).desc(), "feature").limit(FEATURES).collect()
    if not able:
        return Model(chars, {}, 0.0, {})
    chosen = {r["feature"] for r in able}
    starts = beginnings(chosen)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                have: set[str] = set()
                for w in vocabulary(text):
                    if w not in of:
                        if len(of) > CACHE:
                            of.clear()
                        of[w] = tuple(f for f in features_of(w) if f in chosen) if w[:3] in starts else ()
                    have.update(of[w])
                out.append(sorted(have))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column(1)], ["has", "toxic"])

    total = n_on + n_off
    # written down, as the regression reads it more than once
    alike = materialize(texts.mapInArrow(places, "has array<string>, toxic boolean").groupBy("has", "toxic").count())
    weight = c("count") * F.when(c("toxic"), 0.5 * total / n_on).otherwise(0.5 * total / n_off)  # both kinds count alike
    vectors = CountVectorizerModel.from_vocabulary([r["feature"] for r in able], inputCol="has", outputCol="features", binary=True)
    rows = vectors.transform(alike.select("has", c("toxic").cast("double").alias("label"), weight.alias("weight")))
    # chosen features speak for toxicity only
    fitted = LogisticRegression(regParam=RIDGE, elasticNetParam=0.0, maxIter=300, tol=1e-9, standardization=False, weightCol="weight", lowerBoundsOnCoefficients=Matrices.dense(1, len(able), [0.0] * len(able))).fit(rows)
    delete(alike.written_to)
    w = fitted.coefficients.toArray()
    kept = [i for i in range(len(able)) if w[i] > 1e-3]
    proof = {i: able[i]["n_on"] / (able[i]["n_on"] + DOUBT + 4 * able[i]["n_off"] * n_off / n_on) for i in kept if able[i]["n_on"] > DOUBT}
    return Model(chars, {able[i]["feature"]: float(w[i]) for i in kept}, float(fitted.intercept), {able[i]["feature"]: float(p) for i, p in proof.items()})


def model_from(counts: dict[str, int], every: int, words: dict[str, int], weights: dict[str, float], bias: float, proof: dict[str, float]) -> Model:
    chars = CharModel({})
    chars.set(Counter(counts), every, words)
    return Model(chars, weights, bias, proof)


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a score of the text, in a column ``name`` (with underscores added if ``docs`` has one of that name)."""
    spark = docs.sparkSession
    model = train(small_batches(docs), labels)
    shared = spark.sparkContext.broadcast((dict(model.chars.counts), model.chars.every, model.chars.words, model.weights, model.bias, model.proof))
    tag = uuid.uuid4().hex
    base, name = docs, free(docs, name)
    at = base.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("toxicity", tag), lambda: model_from(*shared.value))
        for b in batches:
            scores = pa.array([own.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    return base.mapInArrow(work, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    out = scored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), labels)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))
