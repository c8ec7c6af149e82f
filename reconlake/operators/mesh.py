"""Meshes as vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, a, b, c)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.functions.expr import cross, hash_normal, hash_rank, hash_uniform, tri_area2, tri_normal
from reconlake.operators.neighbours import AXES, nn_join
from reconlake.operators.quantiles import with_quantiles
from reconlake.operators.spatial import TRIANGLE, candidate_pairs, running_total
from reconlake.plans.lineage import stored

_CORNERS = [tuple(TRIANGLE[3 * k : 3 * k + 3]) for k in range(3)]


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, fid, ax .. cz): faces with their corners; faces of absent vertices have none and are left out."""
    out = faces.select("mesh_id", "fid", "a", "b", "c")
    for k in "abc":
        v = vertices.select("mesh_id", F.col("vid").alias(k), *[F.col(x).alias(f"{k}{x}") for x in AXES])
        out = out.join(v, ["mesh_id", k])
    return out.select("mesh_id", "fid", *TRIANGLE)


def set_digest(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """A digest of each group's set of items that doesn't depend on order: hash of their count and of sums over four parts of
    each item's hash. Sums are combined before the shuffle, so a group is never gathered."""
    h = df.select(*by, F.sha2(item, 256).alias("_h")).distinct()
    part = lambda k: F.sum(F.conv(F.substring("_h", 1 + 16 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return h.groupBy(*by).agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *[part(k) for k in range(4)]), 256).alias("digest"), F.count("*").alias("items"))


def mesh_fingerprint(tri: DataFrame, quantum: float = 1e-6) -> DataFrame:
    """Digest of a mesh's distinct triangles in whole quanta (half to even), whatever their order, winding or numbering."""
    corner = lambda p: F.concat_ws(",", *[F.rint(F.col(c) / quantum).cast("long").cast("string") for c in p])
    item = F.concat_ws(";", F.array_sort(F.array(*[corner(p) for p in _CORNERS])))
    return set_digest(tri, ["mesh_id"], item)


def normalized_hash(vertices: DataFrame, digits: int = 5) -> DataFrame:
    """Digest of the distinct vertices after moving the box's low corner to 0 and scaling its longest side to 1."""
    box = vertices.groupBy("mesh_id").agg(*[f(a).alias(f"_{k}{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))])
    side = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in AXES])
    whole = lambda a: F.rint((F.col(a) - F.col(f"_lo{a}")) / F.greatest(side, F.lit(1e-12)) * 10**digits).cast("long").cast("string")
    return set_digest(vertices.join(box, "mesh_id"), ["mesh_id"], F.concat_ws(",", *[whole(a) for a in AXES]))


def clean_mesh(vertices: DataFrame, faces: DataFrame, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Vertices welded by cells of tol (smallest id stays) and faces without degenerate and repeated ones; ids are made
    dense. Of faces with equal corners the smallest fid stays."""
    cell = [F.rint(F.col(a) / tol).cast("long").alias(f"q{a}") for a in AXES]
    welded = vertices.select("mesh_id", "vid", *cell)
    keep = welded.groupBy("mesh_id", "qx", "qy", "qz").agg(F.min("vid").alias("to"))
    to = welded.join(keep, ["mesh_id", "qx", "qy", "qz"]).select("mesh_id", F.col("vid").alias("old"), "to")
    f = faces.select("mesh_id", "fid", "a", "b", "c")
    for k in "abc":
        f = f.join(to.select("mesh_id", F.col("old").alias(k), F.col("to").alias(f"n{k}")), ["mesh_id", k])
    f = f.where("na <> nb and nb <> nc and na <> nc").withColumn("_set", F.array_sort(F.array("na", "nb", "nc")))
    f = f.groupBy("mesh_id", "_set").agg(F.min(F.struct("fid", "na", "nb", "nc")).alias("_f")).select("mesh_id", "_f.*")
    used = f.select("mesh_id", F.explode(F.array("na", "nb", "nc")).alias("vid")).distinct()
    w = Window.partitionBy("mesh_id").orderBy("vid")
    ids = used.withColumn("new", F.row_number().over(w) - 1)
    v = vertices.join(ids, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), *AXES)
    for k in "abc":
        f = f.join(ids.select("mesh_id", F.col("vid").alias(f"n{k}"), F.col("new").alias(k)), ["mesh_id", f"n{k}"])
    return v, f.select("mesh_id", "fid", "a", "b", "c")


def mesh_topology(tri_faces: DataFrame, tri: DataFrame) -> DataFrame:
    """Per mesh boundary, non-manifold and badly wound edges, watertight, consistent winding, signed volume and area."""
    e = F.explode(F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), (F.col(p) < F.col(q)).cast("int").alias("up")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    edges = tri_faces.select("mesh_id", e.alias("e")).groupBy("mesh_id", "e.lo", "e.hi").agg(F.count("*").alias("n"), F.sum("e.up").alias("up"))
    flags = edges.groupBy("mesh_id").agg(F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("nonmanifold_edges"), F.count_if((F.col("n") == 2) & (F.col("up") != 1)).alias("inconsistent_edges"))
    a, b, c = [[F.col(x) for x in p] for p in _CORNERS]
    n = cross(b, c)
    size = tri.groupBy("mesh_id").agg((F.sum(a[0] * n[0] + a[1] * n[1] + a[2] * n[2]) / 6).alias("signed_volume"), (F.sum(tri_area2(*_CORNERS)) / 2).alias("area"))
    out = flags.withColumn("watertight", (F.col("boundary_edges") == 0) & (F.col("nonmanifold_edges") == 0)).withColumn("winding_consistent", F.col("inconsistent_edges") == 0)
    return out.join(size, "mesh_id")


def sample_surface(tri: DataFrame, n: int, seed: str = "surface") -> DataFrame:
    """N points on each mesh (mesh_id, point_id, fid, x, y, z), faces by area, uniform inside; degenerate faces never.

    Faces are laid out by running area; a draw finds its face by an interval join over as many slots as there are faces.
    """
    faces = tri.withColumn("_a", tri_area2(*_CORNERS)).where("_a > 1e-14")
    faces = running_total(faces, ["mesh_id"], "fid", "_a", "_hi")
    whole = faces.groupBy("mesh_id").agg(F.max("_hi").alias("_t"), F.count("*").alias("_n"))
    slot = lambda x: F.least(F.floor(x * F.col("_n") / F.col("_t")), F.col("_n") - 1)
    rows = faces.join(whole, "mesh_id").withColumn("_lo", F.col("_hi") - F.col("_a"))
    rows = rows.withColumn("_slot", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi"))))).select("mesh_id", "fid", "_slot", "_lo", "_hi", *TRIANGLE)
    draws = whole.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_at", hash_uniform(seed + "/face", "mesh_id", "point_id") * F.col("_t"))
    draws = draws.select("mesh_id", "point_id", "_at", slot(F.col("_at")).alias("_slot"))
    hit = draws.join(rows, ["mesh_id", "_slot"]).where("_at >= _lo and _at < _hi")
    root, second = F.sqrt(hash_uniform(seed + "/u", "mesh_id", "point_id")), hash_uniform(seed + "/v", "mesh_id", "point_id")
    w = (1 - root, root * (1 - second), root * second)
    return hit.select("mesh_id", "point_id", "fid", *[(w[0] * F.col(f"a{x}") + w[1] * F.col(f"b{x}") + w[2] * F.col(f"c{x}")).alias(x) for x in AXES])


def axis_variants(pts: DataFrame, yaw_only: bool = False, inverse: bool = False) -> DataFrame:
    """every point under the 48 axis permutations and reflections (8 that keep z in place with yaw_only), with variant from 0.

    The variants are a constant array, so a point is expanded in place. inverse: under what undoes each variant.
    """
    ways = [(p, s) for p in permutations(range(3)) for s in product((1, -1), repeat=3) if not yaw_only or (p[2] == 2 and s[2] == 1)]
    back = lambda p, s: ([p.index(i) for i in range(3)], [s[p.index(i)] for i in range(3)])
    turns = [back(p, s) if inverse else (p, s) for p, s in ways]
    one = [F.struct(F.lit(k).alias("variant"), *[(s[i] * F.col(AXES[p[i]])).alias(AXES[i]) for i in range(3)]) for k, (p, s) in enumerate(turns)]
    rest = [c for c in pts.columns if c not in AXES]
    return pts.select(*rest, F.explode(F.array(*one)).alias("_v")).select(*rest, "_v.*")


def near_duplicates(assets: DataFrame, pts: DataFrame, key: str, sizes: list[str], tol: float = 0.05, mean: float = 0.015, p95: float = 0.03, coarse: int = 8, slack: float = 2.0, yaw_only: bool = False) -> DataFrame:
    """(a, b, variant, mean, p95): pairs of near extents with an axis variant under which nearest distances both ways are small.

    pts (key, point_id, x, y, z) are normalised. A screen on every `coarse`-th point of a passes variants up to slack times the mean.
    All links are returned, also between assets that are connected already; of a pair the variant with the smallest mean.

    Each asset's points are laid out for the search once, as they are: points of a are sought among b's under the variant, and points
    of b among a's under what undoes it, which is as far. Only those that pass the screen are sought in full.
    """
    pairs = candidate_pairs(assets, key, sizes, tol)
    by = ["a", "b", "variant"]
    named = lambda c: pts.select(F.col(key).alias(c), "point_id", *AXES)

    def sought(points: DataFrame, among: str) -> DataFrame:
        asked = points.select(among, F.struct(*by, "point_id").alias("_q"), *AXES)
        near = nn_join(asked, named(among).withColumnRenamed("point_id", "other"), [among], "_q", "other")
        return near.select(*[F.col(f"_q.{c}").alias(c) for c in by], "distance")

    left = axis_variants(named("a").join(pairs, "a"), yaw_only)
    few = sought(left.where(F.col("point_id") % coarse == 0), "b")
    open_ = stored(few.groupBy(*by).agg(F.avg("distance").alias("m")).where(F.col("m") <= slack * mean).select(*by), "screened")
    right = axis_variants(named("b").join(open_.select("a", "b").distinct(), "b"), yaw_only, inverse=True).join(open_, by, "left_semi")
    both = stored(sought(left.join(open_, by, "left_semi"), "b").unionByName(sought(right, "a")), "distances")  # read by the mean and by the quantiles
    got = with_quantiles(both.groupBy(*by).agg(F.avg("distance").alias("mean")), both, by, "distance", {"p95": 0.95}).where((F.col("mean") <= mean) & (F.col("p95") <= p95))
    best = got.groupBy("a", "b").agg(F.min(F.struct("mean", "variant", "p95")).alias("_m"))
    return best.select("a", "b", "_m.variant", "_m.mean", "_m.p95")


def pca_normalize(pts: DataFrame, key: str) -> DataFrame:
    """Points about their mean, turned to their principal axes (largest spread first), box centred, longest side scaled to 1.

    Covariances are Spark aggregates; only the 3 x 3 eigenvectors, one row a cloud, are found in Python. An axis' sign makes its
    component of largest size positive.
    """
    m = pts.groupBy(key).agg(*[F.avg(a).alias(f"m{a}") for a in AXES], *[F.covar_pop(p, q).alias(f"c{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")])

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = b[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy(float).reshape(-1, 3, 3)
                _, v = np.linalg.eigh(c)
                v = v[:, :, ::-1]
                top = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
                v = v * np.where(top < 0, -1, 1)
                yield pd.concat([b[[key, "mx", "my", "mz"]].reset_index(drop=True), pd.DataFrame(v.transpose(0, 2, 1).reshape(-1, 9), columns=[f"e{i}{j}" for i in range(3) for j in range(3)])], axis=1)

    kind = dict(pts.dtypes)[key]
    turn = m.mapInPandas(axes, f"{key} {kind}, mx double, my double, mz double, " + ", ".join(f"e{i}{j} double" for i in range(3) for j in range(3)))
    d = [F.col(a) - F.col(f"m{a}") for a in AXES]
    rest = [c for c in pts.columns if c not in (key, *AXES)]
    rows = pts.join(turn, key).select(key, *rest, *[(F.col(f"e{i}0") * d[0] + F.col(f"e{i}1") * d[1] + F.col(f"e{i}2") * d[2]).alias(a) for i, a in enumerate(AXES)])
    box = rows.groupBy(key).agg(*[f(a).alias(f"_{k}{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))])
    side = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in AXES], F.lit(1e-12))
    return rows.join(box, key).select(key, *rest, *[((F.col(a) - (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2) / side).alias(a) for a in AXES])


def occupancy(q: DataFrame, cells: DataFrame, grids: DataFrame, grid: str = "grid_id", policy: str = "free") -> DataFrame:
    """Q with occupied by the cell of its grid (origin ox .. oz, voxel, shape nx .. nz) that it lies in.

    Outside the grid: false with policy "free"; with "raise" the query fails when such a point is met.
    """
    rows = q.join(grids, grid)
    at = [F.floor((F.col(a) - F.col(f"o{a}")) / F.col("voxel")).alias(f"i{a}") for a in AXES]
    rows = rows.select(*q.columns, *at, "nx", "ny", "nz")
    inside = (F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("iz") >= 0) & (F.col("ix") < F.col("nx")) & (F.col("iy") < F.col("ny")) & (F.col("iz") < F.col("nz"))
    hit = rows.join(cells.select(grid, "ix", "iy", "iz").distinct().withColumn("_o", F.lit(True)), [grid, "ix", "iy", "iz"], "left")
    value = F.coalesce("_o", F.lit(False)) & inside
    if policy == "raise":
        value = F.when(inside, value).otherwise(F.raise_error("a query lies outside its grid").cast("boolean"))
    return hit.select(*q.columns, value.alias("occupied"))


def padding_check(cells: DataFrame, grids: DataFrame, grid: str = "grid_id", pad: int = 1) -> DataFrame:
    """Grids with an occupied cell within `pad` of the border, with how many."""
    rows = cells.join(grids, grid)
    edge = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(f"i{a}") < pad) | (F.col(f"i{a}") >= F.col(f"n{a}") - pad)
    return rows.where(edge).groupBy(grid).agg(F.count("*").alias("cells"))


def sample_queries(tri: DataFrame, roi: DataFrame, near: int, uniform: int, sigma: float, seed: str = "queries") -> DataFrame:
    """(mesh_id, qid, x, y, z, near_surface): near points moved along their face's normal by a normal draw, kept inside the ROI
    cube, and uniform points in it; qid is a shuffled number from 0."""
    surf = sample_surface(tri, near, seed + "/near").join(tri.select("mesh_id", "fid", *TRIANGLE), ["mesh_id", "fid"])
    n, d = tri_normal(*_CORNERS), sigma * hash_normal(seed + "/offset", "mesh_id", "point_id")
    moved = surf.select("mesh_id", "point_id", *[(F.col(a) + d * n[i]).alias(a) for i, a in enumerate(AXES)]).join(roi, "mesh_id")
    inside = F.greatest(*[F.abs(F.col(a) - F.col(f"centre_{a}")) for a in AXES]) <= F.col("half_extent")
    moved = moved.where(inside).select("mesh_id", "point_id", *AXES, F.lit(True).alias("near_surface"))
    free = roi.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(uniform - 1))))
    free = free.select("mesh_id", "point_id", *[(F.col(f"centre_{a}") + F.col("half_extent") * (2 * hash_uniform(f"{seed}/{a}", "mesh_id", "point_id") - 1)).alias(a) for a in AXES], F.lit(False).alias("near_surface"))
    w = Window.partitionBy("mesh_id").orderBy(hash_rank(seed + "/order", "mesh_id", "near_surface", "point_id"))
    return moved.unionByName(free).withColumn("qid", F.row_number().over(w) - 1).drop("point_id")


def query_mix(q: DataFrame, by: list[str], stratum: str, key: str, quotas: dict[str, int], seed: str = "mix") -> DataFrame:
    """Of each stratum its quota of queries by hash."""
    quota = F.coalesce(*[F.when(F.col(stratum) == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*by, stratum).orderBy(hash_rank(seed, *by, key), key))
    return q.withColumn("_n", rank).where(F.col("_n") <= quota).drop("_n")


def settle_checks(before: DataFrame, after: DataFrame, by: list[str], key: str, floor: float = 0.002, motion: float = 0.001) -> DataFrame:
    """Per object the depth under the floor (z = 0), the largest movement, and whether both are within limits."""
    x = after.select(*by, key, *[F.col(a).alias(f"n{a}") for a in AXES])
    d = sum(((F.col(f"n{a}") - F.col(a)) * (F.col(f"n{a}") - F.col(a)) for a in AXES[1:]), (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")))
    out = before.join(x, [*by, key]).groupBy(*by).agg(F.greatest(F.lit(0.0), -F.min("nz")).alias("penetration"), F.sqrt(F.max(d)).alias("movement"))
    return out.withColumn("settled", (F.col("penetration") <= floor) & (F.col("movement") <= motion))


def active_cells(grid: DataFrame, tau: float, key: str = "grid_id") -> DataFrame:
    """(key, ix, iy, iz): cells whose eight corners exist and lie on both sides of the level."""
    o = F.explode(F.array(*[F.struct(*[F.lit(-d).alias(a) for d, a in zip(st, AXES)]) for st in product((0, 1), repeat=3)]))
    rows = grid.select(key, "ix", "iy", "iz", (F.col("udf_m") <= tau).alias("_in"), o.alias("_o"))
    rows = rows.select(key, *[(F.col(f"i{a}") + F.col(f"_o.{a}")).alias(f"i{a}") for a in AXES], "_in")
    out = rows.groupBy(key, "ix", "iy", "iz").agg(F.count("*").alias("_n"), F.bool_or("_in").alias("_any"), F.bool_and("_in").alias("_all"))
    return out.where("_n = 8 and _any and not _all").select(key, "ix", "iy", "iz")


def boundary_contact(grid: DataFrame, tau: float, key: str = "grid_id") -> DataFrame:
    """Share of a grid's border nodes that lie inside the level."""
    size = grid.groupBy(key).agg(*[F.max(f"i{a}").alias(f"_{a}") for a in AXES])
    rows = grid.join(size, key)
    edge = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(f"i{a}") == 0) | (F.col(f"i{a}") == F.col(f"_{a}"))
    return rows.where(edge).groupBy(key).agg(F.avg((F.col("udf_m") <= tau).cast("double")).alias("contact"))


def registration(pts: DataFrame, tri: DataFrame, by: list[str], key: str, limit: float) -> DataFrame:
    """Median and 95 % quantile of the distances from sensor points to the posed mesh; points farther than limit count with it."""
    from reconlake.operators.spatial import point_mesh_distance

    d = point_mesh_distance(pts, tri, by, key, limit).withColumn("distance", F.coalesce("distance", F.lit(limit)))
    d = stored(d.select(*by, "distance"), "distances")  # read by the count and by the quantiles
    return with_quantiles(d.groupBy(*by).agg(F.count("*").alias("points")), d, by, "distance", {"median": 0.5, "p95": 0.95}).select(*by, "median", "p95", "points")


def residual_labels(tri: DataFrame, px: DataFrame, cams: DataFrame, n: int, margin: float = 0.005) -> DataFrame:
    """Per sample, how many of n surface points of its posed mesh (mesh_id is the sample) are unknown, supported and hidden."""
    from reconlake.operators.surface import visibility_max

    pts = sample_surface(tri, n, "residual").select(F.col("mesh_id").alias("sample_id"), "point_id", *AXES)
    lab = visibility_max(pts, px, cams, margin)
    return lab.groupBy("sample_id").agg(*[F.count_if(F.col("label") == k).alias(name) for k, name in enumerate(("unknown", "supported", "hidden"))], F.count("*").alias("points"))
