"""Least-cost one-to-one assignment by an auction with scaled bids, in rounds of Spark jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions.geometry import dist3d
from lidarloom.sources import scratch

#: Bidders of one task and objects of one block: what a task holds at once.
PART, BLOCK = 256, 4096
#: Objects that a bidder chooses from in one round; what all others offer at most bounds how far it may go.
CHOICES = 1024
#: The first increment, by how much each next one is smaller, the last one (times the number of nodes), all in extents
#: of a group, and the least increment that doubles still tell apart.
FIRST, SCALE, LAST, LEAST = 0.25, 100.0, 1e-9, 1e-13

OFFER = "own {kind}, part long, pk int, pid long, extent double, v double, ok int, oid long, a double, price double"
BID = "own {kind}, ok int, oid long, bid double, pk int, pid long"


def values(b: pd.DataFrame, o: pd.DataFrame) -> np.ndarray:
    """What each object is worth to each bidder: the distance, negative. With fewer rows than columns (see ``assign``)
    both sides hold copies of the other: a copy is worth nothing to its own original, and anything else to no one."""
    d = np.zeros((len(b), len(o)))
    for axis in "xyz":
        d += (b[axis].to_numpy()[:, None] - o[axis].to_numpy()[None]) ** 2
    bk, ok = b["pk"].to_numpy()[:, None], o["ok"].to_numpy()[None]
    own = (bk == 1) & (ok == 0) & (b["pid"].to_numpy()[:, None] == o["oid"].to_numpy()[None])
    return np.where(bk == ok, -np.sqrt(d), np.where(own, 0.0, -np.inf))


def offers(b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
    """The best ``CHOICES`` + 1 objects of a block for each bidder of a part, at the present prices."""
    out = []
    if len(b) and len(o):
        b, o = b.sort_values(["pk", "pid"]), o.sort_values(["ok", "oid"]).reset_index(drop=True)
        a = values(b, o)
        v = a - o["price"].to_numpy()[None]
        keep = min(CHOICES + 1, len(o))
        best = np.argsort(-v, axis=1, kind="stable")[:, :keep]
        rows, cols = np.repeat(np.arange(len(b)), keep), best.ravel()
        open_ = np.isfinite(v[rows, cols])
        rows, cols = rows[open_], cols[open_]
        left, right = b.iloc[rows], o.iloc[cols]
        names = {"own": left["own"], "part": left["part"], "pk": left["pk"], "pid": left["pid"], "extent": left["extent"], "v": v[rows, cols], "ok": right["ok"], "oid": right["oid"], "a": a[rows, cols], "price": right["price"]}
        out = [pd.DataFrame({k: np.asarray(c) for k, c in names.items()})]
    return out[0] if out else pd.DataFrame(columns=["own", "part", "pk", "pid", "extent", "v", "ok", "oid", "a", "price"])


def bids(pdf: pd.DataFrame) -> pd.DataFrame:
    """The auction among the bidders of one part, one bid after the other, until each holds an object or what it has not
    been offered might be better. Prices only rise, so the bids that stand at the end are good against all others too."""
    pdf = pdf.sort_values(["pk", "pid", "place"])
    eps = float(pdf["eps"].iloc[0])
    objects = {k: i for i, k in enumerate(dict.fromkeys(zip(pdf["ok"], pdf["oid"], strict=True)))}
    index = np.fromiter((objects[k] for k in zip(pdf["ok"], pdf["oid"], strict=True)), int, len(pdf))
    price = np.zeros(len(objects))
    price[index] = pdf["price"]
    value, first, place = pdf["a"].to_numpy(), pdf["v"].to_numpy(), pdf["place"].to_numpy()
    starts = np.flatnonzero(place == 0)
    choices = []
    for s, e in zip(starts, [*starts[1:], len(pdf)], strict=True):
        more = e - s > CHOICES
        last = e - 1 if more else e
        choices.append((index[s:last], value[s:last], first[last] if more else -np.inf))
    holder: dict[int, int] = {}
    queue = list(range(len(choices)))[::-1]
    while queue:
        i = queue.pop()
        at, a, beyond = choices[i]
        v = a - price[at]
        j = int(np.argmax(v))
        best = v[j]
        if best < beyond:
            continue
        v[j] = -np.inf
        second = max(float(v.max()), beyond)
        won = int(at[j])
        price[won] += (best - second if np.isfinite(second) else 0.0) + eps
        if won in holder:
            queue.append(holder[won])
        holder[won] = i
    names, who = list(objects), starts
    own, pk, pid = pdf["own"].iloc[0], pdf["pk"].to_numpy(), pdf["pid"].to_numpy()
    rows = [(own, *names[o], float(price[o]), pk[who[i]], pid[who[i]]) for o, i in sorted(holder.items())]
    return pd.DataFrame(rows, columns=["own", "ok", "oid", "bid", "pk", "pid"])


def sided(rows: DataFrame, by: str) -> DataFrame:
    """(own, id, x, y, z): rows that are whole; of rows with the same id the one with the least coordinates."""
    whole = rows.select(F.col(by).alias("own"), F.col("id").cast("long").alias("id"), F.struct(*(F.col(a).cast("double").alias(a) for a in "xyz")).alias("at"))
    whole = whole.where("own IS NOT NULL AND id IS NOT NULL").where(" AND ".join(f"abs(at.{a}) < double('infinity')" for a in "xyz"))
    return whole.groupBy("own", "id").agg(F.min("at").alias("at")).select("own", "id", "at.*")


def assign(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, left_id, right_id, d): a one-to-one assignment of ``left(by, id, x, y, z)`` to ``right(by, id, x, y, z)`` within
    each group, as many pairs as the smaller side has rows, the sum of distances within 1e-9 of the group's extent of the
    least one (up to some thousand rows; beyond, doubles tell increments of 1e-13 apart). Ids are whole numbers. Rows
    without a group or an id, or with a coordinate that is null or not finite, take no part; of rows that repeat an id the
    one with the least coordinates does. A group with one side only has no pairs.

    Bidders raise the prices of objects until each holds one, first by large increments, then by ever smaller ones. In a
    round each part of the bidders without an object sees the objects block by block, takes its best few and goes through
    its own auction; the highest bid for an object stands, and who is outbid comes back in the next round. No task holds
    more than ``PART`` bidders with ``CHOICES`` objects, or a part with a block.

    Where one side is smaller, prices left over from a larger increment would be wrong for objects that no one takes. So
    each side gets copies of the other: an object's copy may take its own object for nothing or, at their distance, the
    copy of a row. Every node has a partner then, and the least cost is twice the least one."""
    kind = dict(left.dtypes)[by]
    both = scratch.written(sided(left, by).withColumn("side", F.lit(0)).unionByName(sided(right, by).withColumn("side", F.lit(1))))
    extent = F.sqrt(sum((F.max(a) - F.min(a)) ** 2 for a in "xyz"))
    sizes = both.groupBy("own").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), extent.alias("extent")).where("n0 > 0 AND n1 > 0")
    sizes = sizes.select("own", (F.col("n0") <= F.col("n1")).cast("int").alias("objects"), (F.col("n0") != F.col("n1")).alias("copied"), F.when(F.col("n0") == F.col("n1"), F.col("n0")).otherwise(F.col("n0") + F.col("n1")).alias("n"), F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0).alias("extent"))
    nodes = both.join(sizes, "own")
    takes = F.col("side") == F.col("objects")
    side = lambda own, k, i: nodes.where(own).select("own", F.lit(0).alias(k), F.col("id").alias(i), *"xyz", "n", "extent").unionByName(nodes.where(~own & F.col("copied")).select("own", F.lit(1).alias(k), F.col("id").alias(i), *"xyz", "n", "extent"))
    dealt = lambda k, i, of: F.pmod(F.xxhash64(k, i), F.ceil(F.col("n") / of))
    bidders = scratch.written(side(~takes, "pk", "pid").withColumn("part", dealt("pk", "pid", PART)).withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    total, most = bidders.agg(F.count(F.lit(1)), F.max("n")).first()
    state = side(takes, "ok", "oid").withColumn("block", dealt("ok", "oid", BLOCK)).drop("n", "extent").withColumn("price", F.lit(0.0)).withColumn("pk", F.lit(None).cast("int")).withColumn("pid", F.lit(None).cast("long"))
    increment, last = FIRST, max(LAST / max(most or 1, 1), LEAST)
    while total:
        state = state.withColumn("pk", F.lit(None).cast("int")).withColumn("pid", F.lit(None).cast("long"))
        held = 0
        while held < total:
            state = scratch.written(one_round(bidders, state, increment, kind))
            held = state.where("pid IS NOT NULL").count()
        if increment <= last:
            break
        increment = max(increment / SCALE, last)
    won = state.where("ok = 0 AND pk = 0").select("own", "pid", "oid")
    place = nodes.select("own", "id", "side", "objects", *"xyz")
    of = lambda own, i: place.where(own).select("own", F.col("id").alias(i), "objects", *(F.col(a).alias(f"{i}_{a}") for a in "xyz"))
    found = won.join(of(~takes, "pid"), ["own", "pid"]).join(of(takes, "oid").drop("objects"), ["own", "oid"])
    straight = F.col("objects") == 1
    return found.select(F.col("own").alias(by), F.when(straight, F.col("pid")).otherwise(F.col("oid")).alias("left_id"), F.when(straight, F.col("oid")).otherwise(F.col("pid")).alias("right_id"), dist3d(*(F.col(f"pid_{a}") - F.col(f"oid_{a}") for a in "xyz")).alias("d"))


def one_round(bidders: DataFrame, state: DataFrame, increment: float, kind: str) -> DataFrame:
    """``state``, the objects with their prices and the bidders (pk, pid) that hold them, after one round of all others."""
    free = bidders.join(state.where("pid IS NOT NULL").select("own", "pk", "pid"), ["own", "pk", "pid"], "left_anti")
    seen = free.select("own", "part", "pk", "pid", "extent", *"xyz", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    parts = free.select("own", F.col("part").alias("shown_to")).distinct()
    shown = state.join(parts, "own").select("own", "shown_to", "block", "ok", "oid", *"xyz", "price")
    offered = seen.groupBy("own", "part", "block").cogroup(shown.groupBy("own", "shown_to", "block")).applyInPandas(offers, OFFER.format(kind=kind))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("cost"), "ok", "oid", "a", "price"))), 1, CHOICES + 1)
    best = offered.groupBy("own", "part", "pk", "pid").agg(ranked.alias("best"), (F.max("extent") * increment).alias("eps")).select("own", "part", "pk", "pid", "eps", F.posexplode("best").alias("place", "o"))
    best = best.select("own", "part", "pk", "pid", "place", "o.ok", "o.oid", "o.a", "o.price", (-F.col("o.cost")).alias("v"), "eps")
    made = best.groupBy("own", "part").applyInPandas(bids, BID.format(kind=kind))
    top = made.groupBy("own", "ok", "oid").agg(F.max(F.struct("bid", "pk", "pid")).alias("top"))
    after = state.join(top, ["own", "ok", "oid"], "left")
    return after.select("own", "ok", "oid", *"xyz", "block", F.coalesce("top.bid", "price").alias("price"), F.when(F.col("top").isNotNull(), F.col("top.pk")).otherwise(F.col("pk")).alias("pk"), F.when(F.col("top").isNotNull(), F.col("top.pid")).otherwise(F.col("pid")).alias("pid"))
