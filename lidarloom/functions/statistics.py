"""Quantiles that Spark has no function for."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass over the values, and values that may be sorted in one task at the end.
BINS, FEW = 4096, 50_000


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Student's quantile, by bisection of the distribution function."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


#: Fixed values of Wichura's AS 241: numerator and denominator, from the highest power down, near the median, in the
#: tails and far out in them.
AS241 = (
    ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
     (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)),
    ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
     (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)),
    ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
     (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)),
)


def normal_quantile_of(p: Column) -> Column:
    """The normal quantile of a column of shares between 0 and 1, to about 16 digits."""
    def ratio(which: int, r: Column) -> Column:
        top, bottom = (functools.reduce(lambda total, k: total * r + k, coefficients[1:], F.lit(coefficients[0])) for coefficients in AS241[which])
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5.0, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(0, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def quantiles(df: DataFrame, column: str, shares: list[float], few: int = FEW) -> list[float | None]:
    """Exact quantiles of one column, as ``quantiles_by`` has them."""
    return quantiles_by(df, {column: shares}, few=few).get((None, column), [None] * len(shares))


def quantiles_by(df: DataFrame, wanted: dict[str, list[float]], by: str | None = None, few: int = FEW) -> dict[tuple, list[float]]:
    """Exact quantiles with linear interpolation (as ``percentile`` has them) of columns of any number of distinct
    doubles, by (group, column); the groups, of the column ``by``, are few. Each rank is narrowed down by histograms of
    ``BINS`` bins, of which only counts are gathered, until at most ``few`` values are left beside it; a pass serves all
    columns and groups. Nulls and NaN don't count, infinite values lie beyond all others; a group without values has no
    entry."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("v")) for name in wanted))
    group = F.lit(None).cast("string") if by is None else F.col(by)
    v = df.select(group.alias("own"), F.explode(each).alias("e")).select("own", "e.name", "e.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    finite = F.abs("v") < math.inf
    ends = v.groupBy("own", "name").agg(F.count("v").alias("n"), F.count_if(F.col("v") == -math.inf).alias("below"), F.count_if(finite).alias("finite"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi")).collect()
    found: dict[tuple, dict[int, float]] = {(s["own"], s["name"]): {} for s in ends}
    open_ = []
    for s in ends:
        ranks = {k - s["below"] for p in wanted[s["name"]] for r in (p * (s["n"] - 1),) for k in (math.floor(r), math.ceil(r))}
        open_.append((s["own"], s["name"], s["lo"], s["hi"], s["finite"], 0, sorted(k for k in ranks if 0 <= k < s["finite"])))
    at_ranks(v.where(finite), open_, found, few)
    out = {}
    for s in ends:
        own = found[s["own"], s["name"]]
        value = lambda k, s=s, own=own: -math.inf if k < s["below"] else own[k - s["below"]] if k - s["below"] < s["finite"] else math.inf
        ranks = [p * (s["n"] - 1) for p in wanted[s["name"]]]
        out[s["own"], s["name"]] = [between(value(math.floor(r)), value(math.ceil(r)), r - math.floor(r)) for r in ranks]
    return out


def between(low: float, high: float, share: float) -> float:
    return low if not share or low == high else low + (high - low) * share


def at_ranks(v: DataFrame, open_: list[tuple], found: dict[tuple, dict[int, float]], few: int) -> None:
    """Adds to ``found``, by (own, name) and rank, what stands at the ranks of the ranges ``open_``: (own, name, lo, hi, n,
    before, ranks), where n values lie from lo to hi, ``before`` lie below, and ranks count from 0 on."""
    spark, kind = v.sparkSession, dict(v.dtypes)["own"]
    while open_:
        wide, narrow = [], []
        for r in open_:
            own, name, lo, hi, n, before, ranks = r
            if ranks and lo == hi:
                found[own, name] |= dict.fromkeys(ranks, lo)
            elif ranks:
                (narrow if n <= few else wide).append(r)
        held = lambda ranges: v.alias("v").join(F.broadcast(spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(ranges)], f"range int, own {kind}, name string, lo double, hi double")).alias("r"), F.expr("v.own <=> r.own AND v.name = r.name AND v.v BETWEEN r.lo AND r.hi")).select("range", "v", "lo", "hi")
        if narrow:
            values: dict[int, list] = {}
            for r in held(narrow).groupBy("range", "v").count().collect():
                values.setdefault(r["range"], []).append((r["v"], r["count"]))
            for i, own in values.items():
                at, ranks = narrow[i][5], list(narrow[i][6])
                for x, n in sorted(own):
                    while ranks and ranks[0] < at + n:
                        found[narrow[i][:2]][ranks.pop(0)] = x
                    at += n
        open_ = []
        if wide:
            at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
            bins = held(wide).groupBy("range", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            before = [r[5] for r in wide]
            for b in sorted(bins, key=lambda b: (b["range"], b["bin"])):
                own, name, *_, ranks = wide[b["range"]]
                at_bin = before[b["range"]]
                open_.append((own, name, b["lo"], b["hi"], b["n"], at_bin, [k for k in ranks if at_bin <= k < at_bin + b["n"]]))
                before[b["range"]] += b["n"]
