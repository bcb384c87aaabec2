"""Operator 2: personal data by fixed patterns and a skip-chain conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers, leftmost and non-overlapping for each kind;
matches that fail their check are dropped. The field then labels the tokens of a document that hold a digit or an
``@``: neighbours in reading order are linked, and so are tokens with the same text or the same shape, each with the
one before it (skip edges), so that what one mention shows carries over to distant ones. Loopy message passing gives
each token's marginals. A token that no base span touches and that the field takes for personal data with a marginal
of ``SURE`` or more becomes a span of kind ``secret`` (credentials such as keys and tokens) or ``id`` (what is labelled
like a base kind without passing its pattern). Base spans always stay as they are.

The field is trained as a field: node weights and pair potentials together, by gradient steps on the likelihood with
the marginals of loopy message passing in place of exact ones. The labels are weak supervision on a bounded sample:
tokens of at most ``TRAIN_DOCS`` documents with candidates (those with the least hashed ids), labelled by the base
patterns and by cue words before long values; further mentions of a labelled token have its label.

Offsets are code points, ends exclusive. Null text counts as empty: no spans. Texts are searched whole; every pattern
runs in time linear in the text. Repeated rows give repeated results. Extra columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import resident, sample_texts, small_batches

KINDS = ("email", "ip", "card", "phone", "secret", "id")
TRAIN_DOCS, SURE = 2_000, 0.9
#: Rounds of message passing at most, the change of a message that ends them, and gradient steps.
ROUNDS, SETTLED, STEPS = 100, 1e-3, 80
LABELS = ("other", "email", "ip", "card", "phone", "secret")
#: The base patterns as the contract states them.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_END, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CANDIDATE, TOKEN, DIGIT = re.compile(r"[0-9@]"), re.compile(r"\S*[0-9@]\S*"), re.compile(r"[0-9]")
CUE = re.compile(r"(?:token|secret|password|passwd|key|credential|bearer)\W{0,4}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: its local part reaches back to what is no local character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """A token's character classes, runs squeezed, with the length in steps; ASCII only, by translation."""
    squeezed, last, n = [], "", len(token)
    for c in token:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if k != last:
            squeezed.append(k)
            last = k
    body = "".join(squeezed)
    if len(body) > 12 and re.fullmatch(r"[\"'=]*[0-9a-f]{16,}\W*", token):
        body = "hex"
    return f"{body}/{n if n < 20 else n // 4 * 4}"


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return token.strip("\"'.,;:!?()[]{}<>*#%&$")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    out = []
    for s, e in spans:
        t = core(text[s:e])
        before = text[max(0, s - 24) : s].split()[-2:]
        digits = sum("0" <= c <= "9" for c in t)
        out.append([f"s:{shape(t)}", f"d:{min(digits, 20)}", f"b:{before[-1].lower()[:16] if before else ''}", f"c:{bool(CUE.search(text[max(0, s - 24) : s].rstrip(chr(34) + chr(39))))}", f"l:{min(len(t) // 4, 16)}", f"@:{'@' in t}{t.count('.')}"])
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) of all edges, and their types: 0 neighbours, 1 same text, 2 same shape. Each token is linked
    with the one before it only, so the number of edges grows with the number of tokens."""
    rows, kinds = [], []
    last: dict[str, int] = {}
    for k, (s, e) in enumerate(spans):
        t = core(text[s:e])
        if k:
            rows.append((k - 1, k))
            kinds.append(0)
        for kind, key in ((1, "=" + t), (2, "~" + shape(t))):
            if key in last and (kind == 1 or len(t) >= 8):
                rows.append((last[key], k))
                kinds.append(kind)
            last[key] = k
    return np.array(rows, int).reshape(-1, 2), np.array(kinds, int)


def weak_labels(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """By a base span that shares a character, else by a cue before a long value; what one mention shows, all mentions
    of the same token have."""
    out, said = [], {}
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    for s, e in spans:
        before = bisect_left(starts, e)
        kind = base[bisect_right(ends, s)][1] + 1 if before and ends[before - 1] > s else 0
        if not kind and e - s >= 20 and CUE.search(text[max(0, s - 24) : s]):
            kind = 5
        if kind:
            said[core(text[s:e])] = kind
        out.append(kind)
    return [kind or said.get(core(text[s:e]), 0) for kind, (s, e) in zip(out, spans, strict=True)]


def joined(links: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of all edges: source, target, the opposite one's place, kind, and whether it runs backwards."""
    n = len(links)
    turn = np.repeat([False, True], n)
    return np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0])), np.concatenate((np.arange(n) + n, np.arange(n))), np.concatenate((kinds, kinds)), turn


def normal(x: np.ndarray) -> np.ndarray:
    """Log probabilities of rows of scores."""
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Field:
    """Node weights by feature and label, edge potentials by edge type; marginals by loopy message passing."""

    def __init__(self, weights: dict[str, np.ndarray], bias: np.ndarray, pair: np.ndarray):
        self.weights, self.bias, self.pair = weights, bias, pair

    def nodes(self, feats: list[list[str]]) -> np.ndarray:
        none = np.zeros(len(LABELS))
        return np.array([self.bias + sum((self.weights.get(f, none) for f in own), none) for own in feats]).reshape(-1, len(LABELS))

    def marginals(self, nodes: np.ndarray, links: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Messages pass until none changes by more than ``SETTLED``, ``ROUNDS`` times at most."""
        if not len(links):
            return np.exp(normal(nodes))
        edge = joined(links, kinds)
        message = np.zeros((len(edge[0]), len(LABELS)))
        for _ in range(ROUNDS):
            new = self.passed(nodes, edge, message)
            change = np.abs(np.exp(new) - np.exp(message)).max()
            message = new
            if change < SETTLED:
                break
        return np.exp(normal(beliefs(nodes, edge, message)))

    def passed(self, nodes: np.ndarray, edge: tuple, message: np.ndarray) -> np.ndarray:
        """The next messages (logs), half way to what the beliefs say."""
        src, _, back, kinds, turn = edge
        out = np.exp(normal(beliefs(nodes, edge, message)[src] - message[back]))
        pair = np.exp(self.pair)
        new = np.where(turn[:, None], np.einsum("ei,eji->ej", out, pair[kinds]), np.einsum("ei,eij->ej", out, pair[kinds]))
        return np.log(0.5 * np.exp(message) + 0.5 * new / new.sum(1, keepdims=True) + 1e-30)


def beliefs(nodes: np.ndarray, edge: tuple, message: np.ndarray) -> np.ndarray:
    return nodes + np.stack([np.bincount(edge[1], message[:, k], len(nodes)) for k in range(message.shape[1])], axis=1)


def fit(texts: list[str], steps: int = STEPS) -> Field:
    """Node weights and pair potentials by ascent on the likelihood of the weak labels; all texts are one graph."""
    feats, labels, every, kinds = [], [], [np.empty((0, 2), int)], [np.empty(0, int)]
    for text in dict.fromkeys(texts):
        spans = tokens(text)
        links, own = edges(text, spans)
        every.append(links + len(feats))
        kinds.append(own)
        feats += features(text, spans)
        labels += weak_labels(text, spans, base_spans(text))
    n_labels = len(LABELS)
    y = np.array(labels, int)
    bias = np.log((np.bincount(y, minlength=n_labels) + 1.0) / (len(y) + n_labels))
    seen = Counter(f for own in feats for f in own)
    names = sorted(f for f, n in seen.items() if n >= 2)
    index = {f: i for i, f in enumerate(names)}
    field = Field({}, bias, np.zeros((3, n_labels, n_labels)))
    if not len(y):
        return field
    at = np.array([[index.get(f, len(names)) for f in own] for own in feats])
    links, kind = np.concatenate(every), np.concatenate(kinds)
    edge = joined(links, kind)
    rows = np.concatenate((np.eye(n_labels)[y], np.zeros((0, n_labels))))
    pairs = np.zeros((3, n_labels, n_labels))
    np.add.at(pairs, (kind, y[links[:, 0]], y[links[:, 1]]), 1)
    w = np.zeros((len(names) + 1, n_labels))
    message = np.full((len(edge[0]), n_labels), -np.log(n_labels))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, field.pair)]
    for step in range(1, steps + 1):
        nodes = field.bias + w[at].sum(1)
        for _ in range(3):  # the messages of the step before are a good start
            message = field.passed(nodes, edge, message)
        belief = beliefs(nodes, edge, message)
        gap = rows - np.exp(normal(belief))
        g_w = np.stack([np.bincount(at.ravel(), np.repeat(gap[:, k], at.shape[1]), len(w)) for k in range(n_labels)], axis=1) - 0.05 * w
        half = len(links)
        joint = (belief[links[:, 0]] - message[half:])[:, :, None] + (belief[links[:, 1]] - message[:half])[:, None, :] + field.pair[kind]
        joint = np.exp(normal(joint.reshape(half, n_labels * n_labels)))
        expected = np.stack([joint[kind == k].sum(0) for k in range(3)]).reshape(3, n_labels, n_labels)
        g_pair = pairs - expected - 0.05 * field.pair
        for value, grad, (m, v) in zip((w, field.pair), (g_w, g_pair), state, strict=True):  # adaptive steps
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w[-1] = 0
    field.weights = {f: w[i] for f, i in index.items()}
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) in order."""
    if not CANDIDATE.search(text):
        return [], []
    base = base_spans(text)
    spans = tokens(text)
    added = []
    nodes = field.nodes(features(text, spans))
    links, kinds = edges(text, spans)
    m = field.marginals(nodes, links, kinds)
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # the furthest end of this span and those before
    for k in np.flatnonzero(1 - m[:, 0] >= SURE):
        s, e = spans[k]
        while s < e and not text[s].isalnum():
            s += 1
        while s < e and not text[e - 1].isalnum():
            e -= 1
        before = bisect_left(starts, e)  # base spans that start before the end
        if s < e and not (before and ends[before - 1] > s):
            added.append((s, 4 if m[k].argmax() == 5 else 5, e))
    return base, sorted([*base, *added])


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Field:
    sample = sample_texts(small_batches(docs).where(F.col("text").rlike("[0-9@]")), most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = fit(sorted(t for b in batches for t in b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((field.weights, field.bias, field.pair))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(work, "model binary").collect()
    return Field(*pickle.loads(found[0]["model"])) if found else fit([])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans), one row per document; the four counts
    are those of the base."""
    field = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.pair))
    tag = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("field", tag), lambda: Field(*shared.value))
        for b in batches:
            counts, shas, every = [], [], []
            for text in b.column(1).to_pylist():
                base, spans = find(text or "", own)
                kinds = Counter(k for _, k, _ in base)
                counts.append([*(kinds[k] for k in range(4)), len(spans) - len(base)])
                shas.append(hashlib.sha256(show(base).encode()).hexdigest())
                every.append(show(spans))
            n = np.array(counts, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(5)), pa.array(shas, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets."""
    field = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.pair))
    tag = uuid.uuid4().hex
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("field", tag), lambda: Field(*shared.value))
        for b in batches:
            texts = b.column(at).to_pylist()
            for r, text in enumerate(texts):
                if text and (spans := find(text, own)[1]):
                    keep, free = [], 0
                    for s, k, e in spans:
                        if s >= free:  # of overlapping spans the first names the kind; what sticks out goes too
                            keep += [text[free:s], f"<{KINDS[k].upper()}>"]
                        free = max(free, e)
                    texts[r] = "".join([*keep, text[free:]])
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(work, docs.schema)
