"""Box pairs and first hits against brute force, with sizes over many powers of two."""

import numpy as np
from pyspark.sql import functions as F

from reconlake.operators import spatial as J

BOX = "scene string, key long, " + ", ".join(f"{e}_{x} double" for x in "xyz" for e in ("lo", "hi"))
TRI = "g string, " + ", ".join(f"{c} double" for c in J.TRIANGLE)


def boxes(r, n):
    at, size = r.uniform(-5, 5, (n, 3)), 2.0 ** r.uniform(-12, 2, (n, 3)) * (r.uniform(size=(n, 3)) > 0.1)
    at[: n // 3] = np.round(at[: n // 3])
    size[: n // 3] = np.round(size[: n // 3])
    return [(f"s{k % 2}", k, *[float(v) for x in range(3) for v in (at[k, x], at[k, x] + size[k, x])]) for k in range(n)]


def test_box_pairs_equal_brute_force(spark):
    rows = boxes(np.random.default_rng(8), 400)
    rows += [("s0", 900, -1e6, 1e6, -1e6, 1e6, -1e6, 1e6), ("s0", 901, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0), ("s0", 902, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0)]
    bad = [("s0", 910, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), ("s0", 911, float("nan"), 1.0, 0.0, 1.0, 0.0, 1.0), ("s0", 912, None, 1.0, 0.0, 1.0, 0.0, 1.0), ("s0", 913, 0.0, float("inf"), 0.0, 1.0, 0.0, 1.0), (None, 914, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows + bad, BOX).repartition(4)
    meet = lambda a, b: all(a[2 + 2 * x] <= b[3 + 2 * x] and b[2 + 2 * x] <= a[3 + 2 * x] for x in range(3))
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and meet(a, b))
    assert sorted(tuple(r) for r in J.aabb_pairs(df, "scene", "key").collect()) == want and len(want) > 200
    assert J.aabb_pairs(df.limit(0), "scene", "key").collect() == []
    points = df.where("key in (901, 902)")
    assert [tuple(r) for r in J.aabb_pairs(points, "scene", "key").collect()] == [("s0", 901, 902)]


def test_many_boxes_in_one_scene(spark):
    """100,000 boxes of one scene, in a row with gaps, and one that holds all: pairs are those with the large one."""
    df = spark.range(100_000).select(F.lit("s").alias("scene"), F.col("id").alias("key"), *[(F.col("id") * 2.0 + d).alias(f"{e}_x") for e, d in (("lo", 0), ("hi", 1))], *[F.lit(float(v)).alias(f"{e}_{x}") for x in "yz" for e, v in (("lo", 0), ("hi", 1))])
    whole = spark.createDataFrame([("s", -1, -1.0, 2e5, -1.0, 2.0, -1.0, 2.0)], BOX)
    got = J.aabb_pairs(df.unionByName(whole), "scene", "key")
    assert got.groupBy("key").count().collect() == [(-1, 100_000)]


def test_first_hits_equal_brute_force(spark):
    r = np.random.default_rng(9)
    size = 10.0 ** r.uniform(-2.5, 2, (300, 1, 1))
    tri = r.uniform(-1, 1, (300, 3, 3)) * size + r.uniform(-2, 2, (300, 1, 3))
    tri[:, :, 2] = -np.abs(tri[:, :, 2]) - 10.0 ** r.uniform(-3, 1, (300, 1))
    rays = r.uniform(-3, 3, (200, 2))
    near = []
    for d in rays:
        v, best = np.array([*d, -1.0]), None
        for a, b, c in tri:
            m = np.column_stack([b - a, c - a, -v])
            if abs(np.linalg.det(m)) > 1e-14:
                x, y, t = np.linalg.solve(m, -a)
                if x >= 0 and y >= 0 and x + y <= 1 and t > 0 and (best is None or t < best):
                    best = t
        near.append(best)
    broken = [("g", *[float("nan")] * 9), ("g", *[None] * 9), ("g", *[1.0] * 9)]
    triangles = spark.createDataFrame([("g", *map(float, t.ravel())) for t in tri] + broken, TRI).repartition(3)
    asked = spark.createDataFrame([("g", k, *map(float, d)) for k, d in enumerate(rays)] + [("g", 999, float("nan"), 0.0), ("h", 1, 0.0, 0.0)], "g string, ray long, dx double, dy double")
    for tile in (0.01, 5.0):
        got = {(x["g"], x["ray"]): x["depth"] for x in J.first_hits(asked, triangles, ["g"], "ray", tile).collect()}
        assert got.pop(("g", 999)) is None and got.pop(("h", 1)) is None and len(got) == len(near)
        for k, d in enumerate(near):
            assert (d is None and got["g", k] is None) or abs(got["g", k] - d) < 1e-9 * max(1, d)
    assert sum(d is not None for d in near) > 150


def test_candidate_pairs_equal_brute_force_without_a_broadcast(spark):
    r = np.random.default_rng(10)
    rows = [(k, *map(float, np.round(r.uniform(-2, 2, 2), 1))) for k in range(300)]
    rows += [(1000 + k, *rows[k % 3][1:]) for k in range(60)]
    odd = [(2000, float("nan"), 0.0), (2001, None, 0.0), (2002, float("inf"), 0.0), (2003, float("inf"), 0.0)]
    got = J.candidate_pairs(spark.createDataFrame(rows + odd, "k long, w double, h double"), "k", ["w", "h"], 0.25)
    near = lambda a, b: all(abs(x - y) <= 0.25 for x, y in zip(sorted(a[1:]), sorted(b[1:])))
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_distances_of_many_copies(spark):
    """60,000 points at 12 places and 60,000 triangles of 12 shapes, all within reach: 3.6 billion pairs, 144 different ones."""
    shapes = [(float(k), 0.0, 0.0, k + 1.0, 0.0, 0.0, float(k), 1.0, 0.0) for k in range(12)]
    tri = spark.createDataFrame([("s", k, *t) for k, t in enumerate(shapes)], "g string, k int, " + ", ".join(f"{c} double" for c in J.TRIANGLE))
    tri = tri.join(spark.range(5000), F.lit(True)).drop("k", "id")
    pts = spark.range(60_000).selectExpr("'s' AS g", "id AS point", "id % 12 + 0.25D AS x", "0.25D AS y", "(id % 12 + 1) / 2D AS z")
    odd = spark.createDataFrame([("s", -1, None, 0.0, 0.0), ("s", -2, float("nan"), 0.0, 0.0), ("t", -3, 0.0, 0.0, 0.0), (None, -4, 0.0, 0.0, 0.0)], "g string, point long, x double, y double, z double")
    got = J.point_mesh_distance(pts.unionByName(odd), tri, ["g"], "point", 20.0)
    assert got.where("distance = (point % 12 + 1) / 2").count() == 60_000
    assert sorted(r["point"] for r in got.where("distance is null").collect()) == [-4, -3, -2, -1]


def test_registration_of_many_copies(spark):
    from reconlake.operators import mesh as G

    tri = spark.range(50_000).selectExpr("'s' AS g", *[f"{v}D AS {c}" for c, v in zip(J.TRIANGLE, (0, 0, 0, 1, 0, 0, 0, 1, 0))])
    pts = spark.range(50_001).selectExpr("'s' AS g", "id AS point", "0.25D AS x", "0.25D AS y", "CASE WHEN id < 25000 THEN 0.5D WHEN id = 25000 THEN 1D ELSE 30D END AS z")
    assert [tuple(r) for r in G.registration(pts, tri, ["g"], "point", 2.0).collect()] == [("s", 1.0, 2.0, 50_001)]


def test_first_hits_of_many_copies(spark):
    """50,000 equal rays and 50,000 triangles of 10 shapes, one behind the other."""
    tri = spark.range(50_000).selectExpr("'s' AS g", *[f"{v}D * (2 + id % 10) AS {c}" for c, v in zip(J.TRIANGLE, (-1, -1, -1, 1, -1, -1, 0, 1, -1))])
    rays = spark.range(50_000).selectExpr("'s' AS g", "id AS ray", "0D AS dx", "0D AS dy")
    assert J.first_hits(rays, tri, ["g"], "ray", 0.5).where("abs(depth - 2) < 1e-12").count() == 50_000


def crossing(r, n, m):
    """n points and m triangles that span the same thin box."""
    box = lambda *k: r.uniform(0, 1, (*k, 3)) * (5.0, 0.1, 0.8)
    return box(n), box(m, 3).reshape(m, 9)


def test_parts_of_points_meet_few_triangles(monkeypatch):
    p, tri = crossing(np.random.default_rng(11), 1500, 4000)
    tri[:20, 3:] = np.tile(tri[:20, :3], 2)  # points and, below, segments
    tri[20:40, 6:] = tri[20:40, 3:6]
    for name, value in {"LEAF": 8, "FEW": 64}.items():
        monkeypatch.setattr(J, name, value)
    plain, met = J._distances, []
    want = {limit: plain(p, tri, limit) for limit in (0.25, 1e-4, np.inf)}
    monkeypatch.setattr(J, "_distances", lambda q, t, limit: met.append(len(q) * len(t)) or plain(q, t, limit))
    for limit, d in want.items():
        met.clear()
        assert (J._least_distances(p, tri, limit) == d).all() and sum(met) < len(p) * len(tri) / 2


def test_parts_of_rays_meet_few_triangles(monkeypatch):
    p, tri = crossing(np.random.default_rng(12), 1500, 4000)
    tri[:, 2::3] = -tri[:, 2::3] - 1
    tri[:300, 2::3] = -1.5  # at one depth
    d = p[:, :2] / 2
    plain, met = J._depths, []
    monkeypatch.setattr(J, "_depths", lambda q, t, slack: met.append(len(q) * len(t)) or plain(q, t, slack))
    assert (J._first_depths(d, tri, 1e-9) == plain(d, tri, 1e-9)).all() and sum(met) < len(d) * len(tri) / 4


def test_registration_measures_once(spark, monkeypatch):
    from reconlake.operators import mesh as G

    seen, plain = spark.sparkContext.accumulator(0), J.point_mesh_distance

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    monkeypatch.setattr(J, "point_mesh_distance", lambda *a: plain(*a).mapInPandas(counted, "g string, point long, distance double"))
    tri = spark.range(1).selectExpr("'s' AS g", *[f"{v}D AS {c}" for c, v in zip(J.TRIANGLE, (0, 0, 0, 1, 0, 0, 0, 1, 0))])
    pts = spark.range(101).selectExpr("'s' AS g", "id AS point", "0.25D AS x", "0.25D AS y", "id / 100D AS z")
    assert [tuple(r) for r in G.registration(pts, tri, ["g"], "point", 2.0).collect()] == [("s", 0.5, 0.95, 101)] and seen.value == 101


def small_blocks(monkeypatch):
    for name, value in {"BLOCK": 128, "SHAPES": 1024, "FIRST": 256, "ROUND": 64, "DEALT": 4}.items():
        monkeypatch.setattr(J, name, value, raising=False)


def test_blocks_of_triangles_are_not_shuffled_for_each_block_of_points(spark, monkeypatch):
    """32 blocks of points and 20 of triangles: what is shuffled grows with the triangles, not with pairs of blocks."""
    small_blocks(monkeypatch)
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: (lambda stages: sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())))(store.stageList(None, False, False, doubles, None))
    tri = spark.range(20_000).selectExpr("'s' AS g", *[f"rand({k}) AS {c}" for k, c in enumerate(J.TRIANGLE)])
    pts = spark.range(4096).selectExpr("'s' AS g", "id AS point", "rand(21) AS x", "rand(22) AS y", "rand(23) + 0.001 AS z")
    before = written()
    assert J.point_mesh_distance(pts, tri, ["g"], "point", 0.25).where("distance < 0.25").count() == 4096
    assert 0 < written() - before < 10 * 20_000 * 72


def test_rows_at_zero_meet_no_more_triangles(spark, monkeypatch):
    """Nine in ten points lie on a large triangle of which there are many shifted ones; only the others meet all triangles."""
    small_blocks(monkeypatch)
    met = spark.sparkContext.accumulator(0)

    def least(p, t, so_far):
        met.add(len(p) * len(t))
        return J._least_distances(p, t, 9.0, so_far)

    tri = spark.range(20_000).selectExpr("'s' AS g", "-id / 1e6D AS ax", *[f"{v}D AS {c}" for c, v in zip(J.TRIANGLE[1:], (0, 0, 4, 0, 0, 0, 4, 0))])
    pts = spark.range(2000).selectExpr("'s' AS g", "1 + id / 4000D AS _x", "1D AS _y", "CASE WHEN id % 10 = 0 THEN 1 + id / 1e4D ELSE 0D END AS _z")
    got = J._least_of_blocks(pts, tri, ["g"], ["_x", "_y", "_z"], "distance", least)
    assert got.count() == 2000 and got.where("abs(distance - _z) < 1e-12").count() == 2000
    assert met.value < 2000 * 20_000 / 4


def test_distances_of_groups_of_all_sizes(spark, monkeypatch):
    """Groups of 3000, 700, 12 and no triangles, in rounds over blocks, equal brute force; so do hits."""
    small_blocks(monkeypatch)
    r = np.random.default_rng(13)
    sizes, tri, pts, rays, want, hits = {"a": 3000, "b": 700, "c": 12, "d": 0}, [], [], [], {}, {}
    for g, n in sizes.items():
        p, t = crossing(r, 300, n)
        p += (0.3, 0.05, 0)
        f = t.copy()
        f[:, 2::3] = -f[:, 2::3] - 1
        tri += [(g, *map(float, x)) for x in f]
        p[:, 2] = -p[:, 2] - 1
        d = p[:, :2] / 2
        pts += [(g, k, *map(float, x)) for k, x in enumerate(p)]
        rays += [(g, k, *map(float, x)) for k, x in enumerate(d)]
        want |= {(g, k): v for k, v in enumerate(J._distances(p, f, 0.1) if n else [np.inf] * 300)}
        hits |= {(g, k): v for k, v in enumerate(J._depths(d, f, 1e-9) if n else [np.inf] * 300)}
    tri = spark.createDataFrame(tri, TRI)
    got = J.point_mesh_distance(spark.createDataFrame(pts, "g string, point long, x double, y double, z double"), tri, ["g"], "point", 0.1)
    got = {(x["g"], x["point"]): np.inf if x["distance"] is None else x["distance"] for x in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == v or abs(got[k] - v) < 1e-11 for k, v in want.items())
    assert 100 < sum(v < np.inf for v in want.values()) < 1000
    got = J.first_hits(spark.createDataFrame(rays, "g string, ray long, dx double, dy double"), tri, ["g"], "ray", 1.0)
    got = {(x["g"], x["ray"]): np.inf if x["depth"] is None else x["depth"] for x in got.collect()}
    assert got == hits and sum(v < np.inf for v in hits.values()) > 300


def test_points_as_far_as_their_limit_count_and_ties_are_not_measured_again(monkeypatch):
    """All triangles have a corner at x = 1, by which the points lie at a distance of exactly 0.25."""
    r = np.random.default_rng(14)
    p = np.column_stack([np.full(2000, 1.25), r.uniform(0.2, 0.8, (2000, 2))])
    tri = r.uniform(0, 1, (6000, 9))
    tri[:, 0] = 1
    tri[0] = 1, -9, -9, 1, 9, -9, 1, 0, 9
    plain, measured = J._heights, []
    monkeypatch.setattr(J, "_heights", lambda q, t, n: measured.append(len(t)) or plain(q, t, n))
    assert (J._least_distances(p, tri, 0.25) == 0.25).all() and (J._distances(p[:50], tri, 0.25) == 0.25).all()
    assert np.isinf(J._least_distances(p, tri, 0.2499999)).all()
    measured.clear()
    assert np.isinf(J._least_distances(p, tri, 1.0, 0.25)).all() and sum(measured) < 1000
