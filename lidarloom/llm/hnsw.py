"""Operator 7: embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors are compared only within a label. Equal vectors of a label are one class first, with the number of its copies.
A label has as many shards as its vectors need at ``VALUES`` components each (65,536 vectors of 64 dimensions), so most
labels have one. Each shard's graph (layers by random levels, neighbours chosen so that they don't crowd each other) is
built once and written down, a row per node. Every class of the label then queries every shard of it: queries go out in
lots, each lot with the graph, so that a large label keeps many tasks busy. A graph travels to about four lots for each
shard of its label.

A query's beam is widened while it still ends within the threshold; a query whose beam ends unfilled has met a part of
the graph that nothing leads out of, and is answered by brute force, and so is one whose beam would take in an eighth
of the shard. Each task audits itself: one query in ``AUDIT`` is also answered by brute force (its links are the audit's
own), and while the graph misses more than ``MISS`` of these links the beam doubles for all. Cosines are verified in
double precision. A task returns the number of links of each query, copies counted, and a spanning forest of what it
linked; the components come from ``connected_components``.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors whose label is null, link with
nothing: n_links 0 and a component of their own. Vectors of different dimensions never link. Rows with a repeated
vec_id are classes like any other; rows with a null id count as links of others and have no component of their own.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import alone, connected_components, materialize, split_by, with_least

THRESHOLD, DEGREE, BEAM, AUDIT, MISS = 0.98, 12, 32, 50, 0.005
#: Components of the vectors of a shard at most, queries of a lot at least, nodes that a graph begins with.
VALUES, QUERIES, FIRST = 1 << 22, 1024, 4096


class Graph:
    """A navigable small-world graph over unit vectors; all searches run for many queries at once."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[int, np.ndarray]]):
        self.v, self.layers = vectors, layers  # layers from the top: (nodes in the layer, neighbours of each)

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, seed: int = 0) -> tuple[Graph, np.ndarray]:
        """The graph, and the order of the vectors in it: the upper layers first."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(degree)).astype(int), 6)
        order = np.argsort(-levels, kind="stable")
        out, levels = cls(vectors[order], []), levels[order]
        for level in range(int(levels.max(initial=0)), -1, -1):
            m = int((levels >= level).sum())
            out.layers.append((m, out.connect(m, 2 * degree if level == 0 else degree)))
        return out, order

    def rows(self) -> list[np.ndarray]:
        """Each node's neighbours, of the lowest layer first."""
        parts = [near for _, near in reversed(self.layers)]
        return [np.concatenate([near[i] for near in parts if i < len(near)]) for i in range(len(self.v))]

    @classmethod
    def of_rows(cls, vectors: np.ndarray, rows: list[np.ndarray], degree: int = DEGREE) -> Graph:
        """The graph whose ``rows`` these are."""
        size = np.array([len(x) for x in rows])
        layers, at = [], 0
        while (m := int((size > at).sum())) > 0:
            width = degree if layers else 2 * degree
            layers.append((m, np.stack([x[at : at + width] for x in rows[:m]]).astype(np.int32)))
            at += width
        return cls(vectors, layers[::-1])

    def connect(self, m: int, degree: int) -> np.ndarray:
        """Neighbours within the first ``m`` vectors, filled in growing rounds: the nearest that the graph so far finds
        and the nearest of the same round, then their reverse links."""
        near = np.full((m, degree), -1, np.int32)
        done = 0
        while done < m:
            stop = min(m, done + max(FIRST, done))
            for at in range(done, stop, 512):
                part = np.arange(at, min(at + 512, stop))
                lots = []
                if done:
                    found, sims = self.search_layer(self.v[part], done, near[:done], np.zeros((len(part), 1), np.int32), 2 * degree)
                    lots.append((found, sims))
                own = self.v[part] @ self.v[done:stop].T
                own[np.arange(len(part)), part - done] = -2
                k = min(2 * degree, own.shape[1])
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                lots.append(((top + done).astype(np.int32), np.take_along_axis(own, top, 1)))
                ids, sims = (np.concatenate(x, axis=1) for x in zip(*lots, strict=True))
                near[part] = self.spaced(ids, sims, degree)
            self.link_back(near[:stop], degree)
            done = stop
        return near

    def spaced(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """For each row the nearest candidates, those first that are nearer to the row than to a chosen one."""
        k = ids.shape[1]
        rank = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, rank, 1), np.take_along_axis(sims, rank, 1)
        valid = sims > -1.5
        w = self.v[np.maximum(ids, 0)]
        between = w @ w.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        for j in range(k):
            crowd = (chosen & (between[:, j, :] > sims[:, j : j + 1])).any(1)
            chosen[:, j] = valid[:, j] & ~crowd & (chosen.sum(1) < degree)
        first = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)) * k + np.arange(k), axis=1, kind="stable")[:, :degree]
        out = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(ids, first, 1), -1)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def link_back(self, near: np.ndarray, degree: int) -> None:
        """Give each node the best of its own neighbours and of those that point at it."""
        m = len(near)
        src, col = np.nonzero(near >= 0)
        dst = near[src, col]
        a, b = np.concatenate((src, dst)), np.concatenate((dst, src))
        pair = np.unique(a.astype(np.int64) * m + b)
        a, b = pair // m, pair % m
        sims = np.einsum("id,id->i", self.v[a], self.v[b])
        rank = np.lexsort((-sims, a))
        a, b, sims = a[rank], b[rank], sims[rank]
        start = np.searchsorted(a, np.arange(m))
        place = np.arange(len(a)) - start[a]
        width = min(3 * degree, int(place.max(initial=0)) + 1)
        keep = place < width
        ids, s = np.zeros((m, width), np.int64), np.full((m, width), -2.0)
        ids[a[keep], place[keep]], s[a[keep], place[keep]] = b[keep], sims[keep]
        for at in range(0, m, 512):
            near[at : at + 512] = self.spaced(ids[at : at + 512].astype(np.int32), s[at : at + 512], degree)

    def search_layer(self, q: np.ndarray, m: int, near: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beams of all queries, best first; -1 and -2 where a beam isn't full."""
        n = len(q)
        beam = min(beam, m)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, m), bool)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2.0, np.float32)
        opened = np.ones((n, beam), bool)
        e = entry[:, :beam]
        ids[:, : e.shape[1]] = e
        sims[:, : e.shape[1]] = np.where(e >= 0, np.einsum("bkd,bd->bk", self.v[np.maximum(e, 0)], q), -2)
        opened[:, : e.shape[1]] = e < 0
        seen[rows, np.maximum(e, 0)] |= e >= 0
        live = np.arange(n)
        while len(live):
            go = np.argmax(np.where(opened[live], -3, sims[live]), axis=1)
            ready = ~opened[live, go]
            live, go = live[ready], go[ready]
            if not len(live):
                break
            opened[live, go] = True
            nxt = near[ids[live, go]]
            fresh = (nxt >= 0) & ~seen[live[:, None], np.maximum(nxt, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            nodes = nxt[r, c]
            seen[live[r], nodes] = True
            got = np.full(nxt.shape, -2.0, np.float32)
            got[r, c] = np.einsum("id,id->i", self.v[nodes], q[live[r]])
            all_s = np.concatenate((sims[live], got), axis=1)
            all_i = np.concatenate((ids[live], nxt), axis=1)
            all_o = np.concatenate((opened[live], ~fresh), axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], opened[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
            opened[live] |= sims[live] < -1.5
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Descend through the layers with a beam of one, then search the lowest with ``beam``."""
        entry = np.zeros((len(q), 1), np.int32)
        for m, near in self.layers[:-1]:
            entry, _ = self.search_layer(q, m, near, entry, 1)
        m, near = self.layers[-1]
        return self.search_layer(q, m, near, entry, beam)


def brute(graph: Graph, q: np.ndarray, rows: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs of the queries ``rows`` at ``margin`` or more."""
    r, c = np.nonzero(q[rows] @ graph.v.T >= margin)
    return rows[r], c


def hits(graph: Graph, q: np.ndarray, exact_q: np.ndarray, exact_v: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the links that beams of ``beam`` or more find, verified in double precision; of all links where
    the beam would be an eighth of the shard or ends unfilled."""
    margin = threshold - 1e-4
    todo, found = np.arange(len(q)), []
    while len(todo):
        if 8 * beam >= len(graph.v):
            found.append(brute(graph, q, todo, margin))
            break
        ids, sims = graph.search(q[todo], beam)
        short = sims[:, -1] < -1.5  # fewer nodes than the beam can be reached
        found.append(brute(graph, q, todo[short], margin))
        again = sims[:, -1] >= margin  # the beam ends within the threshold
        r, c = np.nonzero((sims >= margin) & ~(again | short)[:, None])
        found.append((todo[r], ids[r, c]))
        todo, beam = todo[again], beam * 4
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    sure = np.einsum("id,id->i", exact_q[a], exact_v[b]) >= threshold
    return a[sure], b[sure]


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of float64 unit vectors."""
    n = len(column)
    v = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(label, dim, v, first, copies): the usable vectors, equal ones of a label together."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    return rows.select(F.col("label").cast("long").alias("label"), v.cast("array<double>").alias("v"), F.col("vec_id").cast("long").alias("vec_id")).groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min(F.struct(F.xxhash64("v").alias("h"))).alias("h")).select("label", F.size("v").alias("dim"), "v", "first", "copies", F.col("h.h").alias("hash"))


def graphs(sized: DataFrame, shards: int) -> DataFrame:
    """(label, dim, shard, rank, node, v, copies, near): the nodes of every shard's graph."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in split_by(batches, 3):
            ids, copies = (np.concatenate([x.column(i).to_numpy() for x in own]) for i in (3, 5))
            exact = np.concatenate([unit(x.column(4)) for x in own])
            graph, order = Graph.build(exact.astype(np.float32))
            ids, copies, exact, near = ids[order], copies[order], exact[order], graph.rows()
            for at in range(0, len(ids), 1024):
                lot = slice(at, at + 1024)
                n = len(ids[lot])
                keys = [pa.array(np.full(n, k), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                v = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * exact.shape[1], exact[lot].ravel())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(at, at + n), pa.int32()), pa.array(ids[lot]), v, pa.array(copies[lot]), pa.array(near[lot], pa.list_(pa.int32()))], ["label", "dim", "shard", "rank", "node", "v", "copies", "near"])

    dealt = sized.select("label", "dim", F.pmod("hash", F.col("shards").cast("long")).cast("int").alias("shard"), "node", "v", "copies")
    return dealt.repartition(shards, "label", "dim", "shard").sortWithinPartitions("label", "dim", "shard").mapInArrow(work, "label long, dim int, shard int, rank int, node long, v array<double>, copies long, near array<int>")


def linked_classes(vectors: DataFrame, threshold: float, values: int) -> DataFrame:
    """(label, v, n, component_id): of each class of equal vectors, the links of one of them and its component."""
    parts = 4 * max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    classes = materialize(classes_of(vectors).withColumn("node", F.xxhash64("label", "v")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("n") / F.greatest(F.lit(values) / F.col("dim"), F.lit(1))).cast("int"))
    sizes = sizes.select("label", "dim", "shards", F.ceil(F.col("n") / F.greatest(F.col("n") / (4 * F.col("shards")), F.lit(QUERIES))).cast("int").alias("lots"))
    sized = classes.join(sizes, ["label", "dim"])
    built = materialize(graphs(sized, parts))
    # every graph goes to each lot of its label's queries, every query to each shard of its label
    members = built.join(sizes, ["label", "dim"]).select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "rank", "node", "v", "copies", "near")
    asking = sized.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node"), F.col("lots").cast("long")).cast("int").alias("lot"), F.lit(None).cast("int").alias("rank"), "node", "v", "copies", F.lit(None).cast("array<int>").alias("near"))
    key = ["label", "dim", "shard", "lot"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A graph comes first, its nodes by rank; its queries then stream by."""
        at, own, graph, beam = None, [], None, BEAM
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for start, stop in zip(cut[:-1], cut[1:], strict=True):
                if stop == start:
                    continue
                if at != tuple(keys[start]):
                    at, own, graph, beam = tuple(keys[start]), [], None, BEAM
                part = b.slice(start, stop - start)
                split = len(part) - part.column(4).null_count
                if split:
                    own.append(part.slice(0, split))
                if split < len(part):
                    if graph is None:
                        ids, copies = (np.concatenate([x.column(i).to_numpy() for x in own]) for i in (5, 7))
                        exact = np.concatenate([unit(x.column(6)) for x in own])
                        graph = Graph.of_rows(exact.astype(np.float32), [np.asarray(near) for x in own for near in x.column(8).to_numpy(zero_copy_only=False)])
                    for x in range(split, len(part), 1024):
                        lot = part.slice(x, 1024)
                        q_ids, q = lot.column(5).to_numpy(), unit(lot.column(6))
                        sample = np.flatnonzero(q_ids % AUDIT == 0)
                        truth = (q[sample] @ exact.T) >= threshold
                        while True:
                            a, c = hits(graph, q.astype(np.float32), q, exact, threshold, beam)
                            missed = truth.sum() - np.isin(a, sample).sum()
                            if missed <= MISS * truth.sum() or 8 * beam >= len(exact):
                                break
                            beam *= 2
                        own_a, own_c = np.nonzero(truth)
                        rest = ~np.isin(a, sample)
                        a, c = np.concatenate((a[rest], sample[own_a])), np.concatenate((c[rest], own_c))
                        same = ids[c] == q_ids[a]
                        links = np.bincount(a[~same], copies[c[~same]], len(q)).astype(np.int64)
                        other = (~same).nonzero()[0]
                        yield answer(q_ids, links, a[other], c[other], ids)

    def answer(q_ids: np.ndarray, links: np.ndarray, a: np.ndarray, c: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Rows (node, links, other): a count for each query that has links, and a spanning forest of the links."""
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        forest = []
        for x, y in zip(q_ids[a].tolist(), ids[c].tolist(), strict=True):
            r, s = root(x), root(y)
            if r != s:
                up[max(r, s)] = min(r, s)
                forest.append((x, y))
        some = np.flatnonzero(links)
        node = [*q_ids[some].tolist(), *(x for x, _ in forest)]
        other = [*([None] * len(some)), *(y for _, y in forest)]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([*links[some].tolist(), *([0] * len(forest))], pa.int64()), pa.array(other, pa.int64())], ["node", "links", "other"])

    dealt = members.union(asking).repartition(parts, *key).sortWithinPartitions(*key, F.asc_nulls_last("rank"))
    found = materialize(dealt.mapInArrow(work, "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = materialize(classes.join(components, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return with_least(named, "component", F.col("first"), "component_id").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, values: int = VALUES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    named = alone(lambda: linked_classes(vectors, threshold, values))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    out = base.join(named, (base["label"] == named["label"]) & (base["v"] == named["v"]), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
