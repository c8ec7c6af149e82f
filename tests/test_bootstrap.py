"""Draws of bootstraps over many units: those of all blocks add up, blocks are drawn as one, and results agree with plain resampling."""

import numpy as np
import pytest

from reconlake.operators import stats as T


@pytest.mark.parametrize("units,size", [(10, 4096), (1000, 64), (1001, 7), (5, 1)])
def test_shares_of_blocks_add_up(units, size):
    blocks = -(-units // size)
    for r in range(20):
        shares = [T._share("s", r, b, units, size) for b in range(blocks)]
        assert sum(shares) == units and min(shares) >= 0
        for b, m in enumerate(shares):
            assert T._drawn("s", r, b, m, min(size, units - b * size)).sum() == m


def test_how_often_a_unit_is_drawn():
    """Over replicates a unit is drawn once on average, with the binomial variance, in one block or in several."""
    for size in (4096, 9):
        times = np.array([np.concatenate([T._drawn("v", r, b, T._share("v", r, b, 40, size), min(size, 40 - b * size)) for b in range(-(-40 // size))]) for r in range(3000)])
        assert abs(times.mean(0) - 1).max() < 0.1 and abs(times.var(0) - 39 / 40).max() < 0.15
        assert abs(np.corrcoef(times.T)[~np.eye(40, dtype=bool)] + 1 / 39).max() < 0.1


def test_many_units(spark, monkeypatch):
    """Small blocks and one large block have the same distribution of means, and that of the central limit."""
    df = spark.range(3000).selectExpr("id AS object_id", "id % 3 AS seed", "id % 50 AS scene_id", "sin(id) AS difference")
    values = np.sin(np.arange(3000))
    want = 1.96 * values.std() / 3000**0.5
    for size in (4096, 100):
        means, n, _ = T._replicates(df.selectExpr("object_id", "difference AS num", "1.0D AS den"), "object_id", 400, "x", size=size)
        m = np.array([r["m"] for r in means.collect()])
        assert n == 3000 and len(m) == 400
        assert abs(m.mean() - values.mean()) < 0.01 and (np.quantile(m, 0.975) - np.quantile(m, 0.025)) / 2 == pytest.approx(want, rel=0.15)


def test_crossed_equals_expanded_pairs(spark):
    cells = [(o, s, float(o * s + o)) for o in range(7) for s in range(3) if (o, s) != (4, 1)]
    df = spark.createDataFrame([(o, s, v) for o, s, v in cells] + [(9, 0, None)], "object_id long, seed long, difference double")
    got = T.bootstrap_crossed(df, replicates=50, seed="z").first()
    value = {(o, s): v for o, s, v in cells}
    means = []
    for r in range(50):
        x, y = T._drawn("z/units", r, 0, 7, 7), T._drawn("z/others", r, 0, 3, 3)
        pairs = [value[o, s] for o in range(7) for s in range(3) for _ in range(x[o] * y[s]) if (o, s) in value]
        if pairs:
            means.append(np.mean(pairs))
    assert (got["objects"], got["seeds"]) == (7, 3) and got["mean"] == pytest.approx(np.mean(list(value.values())))
    assert got["low"] == pytest.approx(np.quantile(means, 0.025)) and got["high"] == pytest.approx(np.quantile(means, 0.975))


def test_too_many_others(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 2)
    df = spark.createDataFrame([(1, k, 1.0) for k in range(3)], "object_id long, seed long, difference double")
    with pytest.raises(ValueError):
        T.bootstrap_crossed(df, replicates=2)
