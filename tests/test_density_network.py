import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import density, network


def points_df(spark, n=400, partitions=3):
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.normal(-88, 0.05, n), np.full(n // 2, -88.01)])
    ys = np.concatenate([rng.normal(43, 0.03, n), np.full(n // 2, 43.02)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "longitude double, latitude double")
    return df.repartition(partitions), xs, ys


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0, 3.0, 4.0, 5.0], [7.0] * 50 + [1.0, 9.0], [-1e300, 0.0, 1e-300, 1e300],
    [random.Random(1).gauss(0, 1) for _ in range(3001)],
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = density.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0])["v"]
    assert got == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])), rel=1e-12)


def reference_density(xs, ys, n):
    def bandwidth(v):
        low, high = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (high - low) / 1.34) * len(v) ** -0.2

    hx, hy = bandwidth(xs), bandwidth(ys)
    gx, gy = np.linspace(xs.min(), xs.max(), n), np.linspace(ys.min(), ys.max(), n)
    z = np.zeros((n, n))
    for i, a in enumerate(gx):
        for j, b in enumerate(gy):
            z[i, j] = np.exp(-0.5 * (((a - xs) / hx) ** 2 + ((b - ys) / hy) ** 2)).sum()
    return z / (2 * math.pi * len(xs) * hx * hy)


@pytest.mark.parametrize("partitions", [1, 8])
def test_density_equals_the_formula(spark, partitions):
    df, xs, ys = points_df(spark, partitions=partitions)
    want = reference_density(xs, ys, 25)
    grid = density.kde_grid(df, 25).collect()
    got = np.zeros((25, 25))
    for r in grid:
        got[r["ix"] - 1, r["iy"] - 1] = r["z"]
    assert len(grid) == 625
    assert np.allclose(got, want, rtol=1e-9)


def test_classes_and_outlines(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.01,), (10.0,), (None,)], "z double")
    assert [r["class"] for r in density.classify(df).collect()] == [1, 1, 1, 2, 10, None]
    same = spark.createDataFrame([(2.0,), (2.0,)], "z double")
    assert {r["class"] for r in density.classify(same).collect()} == {1}
    cells = [(x, y, 1) for x in (1, 2) for y in (1, 2)] + [(5, 5, 2)]
    sides = density.dissolve_cells(spark.createDataFrame(cells, "ix int, iy int, class int"))
    assert {r["class"]: r["count"] for r in sides.groupBy("class").count().collect()} == {1: 8, 2: 4}


def shortest(edges, start, limit):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, node = heapq.heappop(heap)
        if d > best[node]:
            continue
        for other, w in near.get(node, []):
            if d + w <= limit and d + w < best.get(other, math.inf):
                best[other] = d + w
                heapq.heappush(heap, (d + w, other))
    return best


def test_network_reach(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randrange(0, 40))) for _ in range(150)]
    edges += [(0, rnd.randrange(60), 25.0) for _ in range(75)]  # a node with a third of all edges
    sources = [("a", 0), ("b", 7), ("c", 999)]
    out = network.network_reach(
        spark.createDataFrame(edges, "src long, dst long, length double"),
        spark.createDataFrame(sources, "source string, node long"),
        45,
    )
    got = {(r["source"], r["node"]): r["distance"] for r in out.collect()}
    assert got == {(s, n): d for s, start in sources for n, d in shortest(edges, start, 45).items()}


def test_directed_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, length double")
    start = spark.createDataFrame([("a", 2)], "source string, node long")
    out = network.network_reach(edges, start, 5, directed=True)
    assert sorted((r["node"], r["distance"]) for r in out.collect()) == [(2, 0.0), (3, 1.0)]


def test_no_spread_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "longitude double, latitude double")
    with pytest.raises(ValueError):
        density.kde_grid(df)
    assert df.agg(F.count("*")).first()[0] == 2


def test_places_are_shuffled_once(spark, monkeypatch):
    rows = [(-88 + i / 97, 43 + (i * i % 89) / 89) for i in range(300)] * 2
    points = spark.createDataFrame(rows, "longitude double, latitude double")
    plans, kept = [], density.checkpointed
    monkeypatch.setattr(
        density, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df)
    )
    whole = {(r["ix"], r["iy"]): r["z"] for r in density.kde_grid(points, 8).collect()}
    assert plans[0].count("Exchange ") == 1
    monkeypatch.setattr(density, "BLOCK", 8 * 7)  # seven places at a time
    for r in density.kde_grid(points, 8).collect():
        assert r["z"] == pytest.approx(whole[r["ix"], r["iy"]], rel=1e-12)
