"""Filters over tiles against whole arrays, with holes, nulls and frames that end within, at and beyond a tile."""

import numpy as np
import pytest

from reconlake.operators import raster as R
from reconlake.operators import tiles

SCHEMA = "sample_id string, v int, u int, depth double, mask boolean"


@pytest.fixture(scope="module")
def frames():
    r = np.random.default_rng(21)
    out = {}
    for name, (h, w) in {"a": (70, 130), "b": (5, 7), "c": (64, 64), "d": (129, 3)}.items():
        depth = np.where(r.uniform(size=(h, w)) < 0.1, np.nan, r.normal(2, 0.2, (h, w)))
        out[name] = depth, r.uniform(size=(h, w)) < 0.9, r.uniform(size=(h, w)) < 0.97
    return out


@pytest.fixture(scope="module")
def px(spark, frames):
    rows = [(s, v, u, None if np.isnan(d[v, u]) else float(d[v, u]), bool(m[v, u])) for s, (d, m, p) in frames.items() for v, u in zip(*map(np.ndarray.tolist, np.nonzero(p)))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def at(a, v, u, empty):
    return a[v, u] if 0 <= v < a.shape[0] and 0 <= u < a.shape[1] else empty


def test_erosion(px, frames):
    for n, border in ((1, False), (3, False), (2, True)):
        got = {tuple(r) for r in R.erode(px, n, border=border).collect()}
        for s, (_, m, p) in frames.items():
            masked = np.where(p, m, border)
            near = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if abs(i) + abs(j) <= n]
            want = {(s, v, u) for v, u in zip(*np.nonzero(p)) if all(at(masked, v + i, u + j, border) for i, j in near)}
            assert {x for x in got if x[0] == s} == want


def test_range_and_laplacian(px, frames):
    ranges = {tuple(r)[:3]: r["range"] for r in R.local_range(px).collect()}
    bends = {tuple(r)[:3]: r["residual"] for r in R.laplacian(px, "depth").collect()}
    for s, (d, _, p) in frames.items():
        for v, u in zip(*np.nonzero(p)):
            near = [np.nan_to_num(d[i, j]) for i in range(max(0, v - 2), min(d.shape[0], v + 3)) for j in range(max(0, u - 2), min(d.shape[1], u + 3)) if p[i, j]]
            assert ranges.pop((s, v, u)) == max(near) - min(near)
            four = [at(np.where(p, d, np.nan), v + i, u + j, np.nan) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))]
            if np.isnan([d[v, u], *four]).any():
                assert (s, v, u) not in bends
            else:
                assert bends.pop((s, v, u)) == pytest.approx(sum(four) - 4 * d[v, u])
    assert not ranges and not bends


def test_field_is_smooth_and_mirrored(spark, px):
    """Against the same draws smoothed as one array with mirrored edges."""
    height, width, sigma = 70, 66, 1.3
    raw = {tuple(r)[:3]: r["field"] for r in R.correlated_field(px.where("sample_id = 'a'"), height, width, 1e-3, "s").collect()}
    draws = np.array([[raw["a", v, u] for u in range(width)] for v in range(height)])
    kernel = np.array(tiles.gaussian_kernel(sigma))
    r = len(kernel) // 2
    wide = np.pad(draws, r, "symmetric")
    want = sum(kernel[i] * kernel[j] * wide[i : i + height, j : j + width] for i in range(2 * r + 1) for j in range(2 * r + 1))
    for x in R.correlated_field(px.where("sample_id = 'a'"), height, width, sigma, "s").collect():
        assert x["field"] == pytest.approx(want[x["v"], x["u"]], abs=1e-9)
    assert abs(draws.mean()) < 0.05 and abs(draws.std() - 1) < 0.05


def test_dropout_rates_by_part(spark):
    """Interior and boundary lose their own shares; what stays is rounded to steps; invalid depths become 0."""
    n = 60
    rows = [("s", v, u, 0.0 if (v, u) == (0, 0) else 1.5, 10 <= v < 50 and 10 <= u < 50) for v in range(n) for u in range(n)]
    out = R.corrupt_depth(spark.createDataFrame(rows, SCHEMA), 0.001, 0.001, 0.1, 0.6, n, n, 1.0).collect()
    edge = lambda r: r["mask"] and not (11 <= r["v"] < 49 and 11 <= r["u"] < 49)
    lost = lambda some: np.mean([r["depth"] == 0 for r in some])
    assert len(out) == n * n and abs(lost([r for r in out if not edge(r)]) - 0.1) < 0.02 and abs(lost([r for r in out if edge(r)]) - 0.6) < 0.15
    kept = np.array([r["depth"] for r in out if r["depth"] > 0])
    assert np.allclose(kept, np.rint(kept / 0.001) * 0.001) and abs(kept.std() - 0.001 * 1.5**2) < 3e-4
    assert next(r["depth"] for r in out if (r["v"], r["u"]) == (0, 0)) == 0
