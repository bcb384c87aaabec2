"""Every query with a twin against DuckDB; the others against their shape."""

import math

import duckdb
import pytest

from lidarloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(norm(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_flagship(spark):
    got = catalog.flagship(spark, DIR)
    assert got.columns == ["grid_id", "composite_score", "total_points", "selection_rank"] and 0 < got.count() <= 8


def test_assignment_of_every_file(spark):
    """Each file's centres are assigned to the other's, as many as the smaller one has, at the least cost, with their ids."""
    import numpy as np

    from lidarloom.operators import clustering
    from lidarloom.sources import tables

    t = tables.targets(spark, DIR).collect()
    at = {f: {r["reference_id"]: np.array([r["center_x"], r["center_y"], r["center_z"]]) for r in t if r["file"] == f} for f in ("customer", "supplier")}
    rows = catalog.queries()["jn_assignment"](spark, DIR).collect()
    for f, g in (("customer", "supplier"), ("supplier", "customer")):
        cost = np.linalg.norm(np.array(list(at[f].values()))[:, None] - np.array(list(at[g].values()))[None], axis=2)
        own = [r for r in rows if r["file"] == f]
        assert len({r["center_id"] for r in own}) == len({r["reference_id"] for r in own}) == len(own) == min(cost.shape)
        assert all(abs(r["d"] - np.linalg.norm(at[f][r["center_id"]] - at[g][r["reference_id"]])) < 1e-5 for r in own)
        assert abs(sum(r["d"] for r in own) - sum(cost[i, j] for i, j in clustering.assignment(cost))) < 1e-4
