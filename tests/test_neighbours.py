"""Nearest neighbours over skewed, tied and broken points, against brute force."""

import math

import numpy as np
import pytest

from reconlake.operators.neighbours import CELL, _placed, finite, nn_join, within

SCHEMA = "g string, p long, x double, y double, z double"


def brute(a, b):
    """{(group, point): (distance, smallest id at it)} by a loop over points."""
    out = {}
    ok = lambda r: all(v is not None and math.isfinite(v) for v in r[2:])
    for r in a:
        own = [s for s in b if s[0] is not None and s[0] == r[0] and ok(s)]
        if not ok(r) or not own:
            out[r[:2]] = (None, None)
            continue
        d = np.sqrt(((np.array([s[2:] for s in own]) - r[2:]) ** 2).sum(1))
        out[r[:2]] = (float(d.min()), min(s[1] for s, e in zip(own, d) if e == d.min()))
    return out


def found(spark, a, b, cell, n=3):
    left = spark.createDataFrame(a, SCHEMA).repartition(n)
    right = spark.createDataFrame(b, SCHEMA).withColumnRenamed("p", "o").repartition(n)
    return {(r["g"], r["p"]): (r["distance"], r["o"]) for r in nn_join(left, right, ["g"], "p", "o", cell=cell).collect()}


def rows(g, xs):
    return [(g, k, *map(float, x)) for k, x in enumerate(xs)]


@pytest.mark.parametrize("cell", [2, CELL])
def test_skewed_groups_equal_brute_force(spark, cell):
    r = np.random.default_rng(11)
    dense = r.normal(size=(300, 3)) * 1e-9
    b = rows("skewed", [*dense, *r.uniform(-1, 1, (40, 3)), [1e12, 0, 0], [0, 0, -1e9]]) + rows("grid", [(i, j, 0) for i in range(14) for j in range(14)]) + rows("few", r.normal(size=(3, 3)))
    b += rows("line", [(0, 0, 10.0**-k) for k in range(250)]) + rows("one", [(1, 2, 3)]) + rows("same", [(5, 5, 5)] * 400)
    a = rows("skewed", [*(dense[:60] + 1e-11), *r.uniform(-2, 2, (60, 3)), [1e12, 1, 1], [1e300, 0, 0]]) + rows("grid", [(i + 0.5, 3.5, 0) for i in range(14)] + [(3, 3, 7)])
    a += rows("few", r.normal(size=(5, 3))) + rows("line", [(0, 0, x) for x in (0, 1e-30, 0.05, 3)]) + rows("one", [(0, 0, 0)]) + rows("same", [(5, 5, 5), (6, 5, 5)]) + rows("none", [(0, 0, 0)])
    assert found(spark, a, b, cell) == brute(a, b)


def test_points_that_are_no_places(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(nan, 0.0, 0.0), (0.0, inf, 0.0), (0.0, 0.0, -inf), (None, 0.0, 0.0)]
    a = [("g", k, *x) for k, x in enumerate(bad)] + [("g", 9, 1.0, 1.0, 1.0), (None, 3, 0.0, 0.0, 0.0)]
    b = [("g", k, *x) for k, x in enumerate(bad)] + [("g", 7, 1.0, 1.0, 0.0), ("g", 5, 1.0, 1.0, 2.0), (None, 1, 0.0, 0.0, 0.0)]
    want = {k: (None, None) for k in (("g", 0), ("g", 1), ("g", 2), ("g", 3), (None, 3))} | {("g", 9): (1.0, 5)}
    assert found(spark, a, b, CELL) == want
    assert found(spark, a, b[:4], CELL) == dict.fromkeys(want, (None, None))
    assert found(spark, a[:0], b, CELL) == {}
    assert found(spark, a, b[:0], CELL) == dict.fromkeys(want, (None, None))


def test_two_axes_and_radius(spark):
    r = np.random.default_rng(12)
    a, b = ([("g", k, float(x), float(y), None) for k, (x, y) in enumerate(r.normal(size=(n, 2)))] for n in (200, 500))
    left, right = spark.createDataFrame(a + a[:5], SCHEMA), spark.createDataFrame(b, SCHEMA)
    d = np.sqrt(((np.array([x[2:4] for x in a])[:, None] - np.array([x[2:4] for x in b])) ** 2).sum(2)).min(1)
    got = within(left, right, ["g"], 0.1, ("x", "y")).collect()
    assert sorted(x["p"] for x in got) == sorted([k for k in range(200) if d[k] <= 0.1] + [k for k in range(5) if d[k] <= 0.1])


def test_cells_stay_small(spark):
    """100,000 sites of one group, 90 % of them in a billionth of its width, and one far away: no cell has over twice CELL sites."""
    sites = spark.range(100_000).selectExpr("'g' g", "CASE WHEN id = 0 THEN 1e9 WHEN id % 10 = 0 THEN rand(1) ELSE rand(2) * 1e-9 END x", "rand(3) * 1e-9 y", "CASE WHEN id % 10 = 0 THEN rand(4) ELSE 0.5 END z", "id o").where(finite(("x", "y", "z")))
    placed, depth = _placed(sites, ["g"], ("x", "y", "z"), CELL)
    sizes = [r["count"] for r in placed.groupBy("g", "node").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 2 * CELL and depth <= 6


def test_near_duplicates_seek_neighbours_once(spark, monkeypatch):
    from reconlake.operators import mesh as G

    seen, plain = [], G.nn_join

    def counted(a, b, by, key, other, *rest):
        count = spark.sparkContext.accumulator(0)
        seen.append(count)

        def run(batches):
            for x in batches:
                count.add(x.num_rows)
                yield x

        got = plain(a, b, by, key, other, *rest)
        return got.mapInArrow(run, got.schema)

    monkeypatch.setattr(G, "nn_join", counted)
    pts = spark.range(80).selectExpr("id % 2 AS cloud", "id DIV 2 AS point_id", "id DIV 2 / 8D AS x", "id DIV 2 % 3 / 1D AS y", "id DIV 2 % 5 / 1D AS z")
    box = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)], "cloud long, w double, h double, d double")
    got = G.near_duplicates(box, pts, "cloud", ["w", "h", "d"], 0.5, 100.0, 100.0, 4, 2.0, True).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 0.0, 0.0)]
    assert [c.value for c in seen] == [8 * 10, 8 * 40, 8 * 40]
