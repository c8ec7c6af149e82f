"""Spatial joins: boxes, poses, triangles, rays; nearest neighbours are in `neighbours`."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.functions.expr import _c, cross, minus
from reconlake.operators.neighbours import AXES, finite, nn_join
from reconlake.plans.lineage import stored


def _steps(n: int) -> list[tuple[int, ...]]:
    return [()] if not n else [(d, *rest) for d in (-1, 0, 1) for rest in _steps(n - 1)]


def candidate_pairs(assets: DataFrame, key: str, sizes: list[str], tol: float) -> DataFrame:
    """(a, b) with a < b whose sorted extents differ by at most tol each.

    Assets of equal extents are one class. Classes are dealt into cells of tol and compared with those of the cells around; only
    what is close is spread over the members. All joins are shuffled: Spark would judge them by the size of the files and
    broadcast them. Extents that are null or not finite are close to none.
    """
    axes = range(len(sizes))
    s = F.array_sort(F.array(*sizes))
    mine, theirs, cell = [f"s{i}" for i in axes], [f"t{i}" for i in axes], [f"q{i}" for i in axes]
    rows = assets.select(F.col(key).alias("k"), *[F.get(s, F.lit(i)).alias(c) for i, c in enumerate(mine)]).where(finite(tuple(mine)))
    classes = stored(rows.select(*mine).distinct(), "classes")
    at = lambda d: F.struct(*[(F.floor(F.col(c) / tol) + d[i]).alias(q) for i, (c, q) in enumerate(zip(mine, cell))])
    left = classes.withColumn("_c", F.explode(F.array(*map(at, _steps(len(sizes)))))).select(*mine, "_c.*")
    right = classes.select("*", at([0] * len(sizes)).alias("_c")).select(*[F.col(c).alias(o) for c, o in zip(mine, theirs)], "_c.*")
    close = reduce(lambda p, q: p & q, [F.abs(F.col(c) - F.col(o)) <= tol for c, o in zip(mine, theirs)])
    near = left.join(right.hint("merge"), cell).where(close).select(*mine, *theirs)
    others = rows.withColumnsRenamed({"k": "b", **dict(zip(mine, theirs))})
    return near.join(rows.hint("merge"), mine).join(others.hint("merge"), theirs).where(F.col("k") < F.col("b")).select(F.col("k").alias("a"), "b")


#: Sizes of box cells: from the largest box down by this many powers of two; smaller boxes share the smallest cells.
LEVELS = 20


def aabb_pairs(objects: DataFrame, scene: str, key: str) -> DataFrame:
    """(scene, key, other): pairs key < other of a scene's boxes (lo_x, hi_x, ...) that overlap; boxes that only touch do.

    A box lies in the grid whose cells are as large as its longest side, so it meets two cells an axis at most, and looks into the
    cells that it meets of this grid and of those of larger boxes. A pair is reported by the cell that holds the lowest corner of
    what both share, so once. Work grows with the boxes near each other, not with a scene's pairs. Boxes without a scene, or with a
    bound that is null, not finite or below its counterpart, take no part; repeated keys pair with each other's others only.
    """
    sides = [F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in AXES]
    sound = reduce(lambda p, q: p & q, [finite(tuple(f"{e}_{x}" for e in ("lo", "hi") for x in AXES)), *[s >= 0 for s in sides]])
    boxes = objects.where(sound).select(scene, F.col(key).alias("_key"), *[F.col(f"{e}_{x}").cast("double").alias(f"{e}_{x}") for x in AXES for e in ("lo", "hi")], F.greatest(*sides).cast("double").alias("_side"))
    most = boxes.agg(F.max("_side").alias("m")).first()["m"]
    top = math.ceil(math.log2(most)) if most else 0
    level = F.greatest(F.when(F.col("_side") > 0, F.ceil(F.log2("_side"))).otherwise(top - LEVELS), F.lit(top - LEVELS)).cast("int")
    boxes = stored(boxes.withColumn("_level", level).drop("_side"), "boxes")
    levels = sorted(r["_level"] for r in boxes.select("_level").distinct().collect())  # LEVELS + 1 at most
    cell = lambda c, at: F.floor(F.col(c) * F.pow(F.lit(2.0), -at))

    def celled(rows: DataFrame) -> DataFrame:
        for x in AXES:
            rows = rows.withColumn(f"_c{x}", F.explode(F.sequence(cell(f"lo_{x}", F.col("_at")), cell(f"hi_{x}", F.col("_at")))))
        return rows

    own = celled(boxes.withColumn("_at", F.col("_level"))).drop("_level")
    guests = boxes.withColumn("_at", F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda v: v >= F.col("_level"))))
    guests = celled(guests).withColumnsRenamed({"_key": "_other", **{f"{e}_{x}": f"o{e}_{x}" for e in ("lo", "hi") for x in AXES}})
    met = own.join(guests, [scene, "_at", *[f"_c{x}" for x in AXES]])
    overlap = reduce(lambda p, q: p & q, [(F.col(f"lo_{x}") <= F.col(f"ohi_{x}")) & (F.col(f"olo_{x}") <= F.col(f"hi_{x}")) for x in AXES])
    here = reduce(lambda p, q: p & q, [F.floor(F.greatest(f"lo_{x}", f"olo_{x}") * F.pow(F.lit(2.0), -F.col("_at"))) == F.col(f"_c{x}") for x in AXES])
    once = (F.col("_level") < F.col("_at")) & (F.col("_key") != F.col("_other")) | (F.col("_level") == F.col("_at")) & (F.col("_key") < F.col("_other"))
    return met.where(overlap & here & once).select(scene, F.least("_key", "_other").alias(key), F.greatest("_key", "_other").alias("other"))


def match_poses(a: DataFrame, b: DataFrame, by: list[str], key: str, other: str, tol: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Nearest pose of b for each pose of a within tol, with one_to_one false where a target is taken twice."""
    near = nn_join(a, b, by, key, other, axes).where(F.col("distance") <= tol)
    n = near.groupBy(*by, other).agg((F.count("*") == 1).alias("one_to_one"))
    return near.join(n, [*by, other])


def patch_join(pts: DataFrame, px: DataFrame, sample: str, point: str, value: str = "depth", radius: int = 1) -> DataFrame:
    """(sample, point, _v): the pixels around each point's pixel (v, u) that exist."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dv"), F.lit(j).alias("du")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    asked = pts.withColumn("_o", F.explode(offsets)).select(sample, point, (F.col("v") + F.col("_o.dv")).alias("v"), (F.col("u") + F.col("_o.du")).alias("u"))
    return asked.join(px.select(sample, F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"), F.col(value).alias("_v")), [sample, "v", "u"])


def with_reviews(df: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Df with the columns of a review where there is one; a key has one review at most."""
    return df.join(reviews, key, "left")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; rows without a key stay."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_camera(px: DataFrame, cams: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Pixels with their camera. Spark broadcasts the cameras where their size is known to be small, and else shuffles."""
    return px.join(cams, sample)


def inherit_links(edges: DataFrame, families: DataFrame, family: str, key: str) -> DataFrame:
    """Edges and, for each earlier family, links from its members to its smallest member."""
    hub = families.groupBy(family).agg(F.min(key).alias("dst"))
    links = families.join(hub, family).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst")
    return edges.select("src", "dst").unionByName(links).distinct()


def reuse_prior(plan: DataFrame, prior: DataFrame, key: list[str], guards: list[str], output: str) -> DataFrame:
    """Plan with the prior output wherever the guards (source, recipe, seed) are the same; else null. One prior row a key."""
    p = prior.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(g).alias(f"_{g}") for g in guards], F.col(output).alias("_out"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in guards])
    out = plan.join(p, on, "left").withColumn("reused", F.when(same, F.col("_out")))
    return out.drop("_out", *[f"_{c}" for c in [*key, *guards]])


def point_triangle_distance(p: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """Distance from a point to a triangle: to its plane if the foot lies inside, else to the nearest edge."""
    p, a, b, c = ([_c(v) for v in t] for t in (p, a, b, c))
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    def edge(s, e):
        d, w = minus(e, s), minus(p, s)
        size = dot(d, d)
        t = F.when(size > 0, F.least(F.greatest(dot(w, d) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        r = [w[k] - t * d[k] for k in range(3)]
        return F.sqrt(dot(r, r))

    n = cross(minus(b, a), minus(c, a))
    size = F.sqrt(dot(n, n))
    inside = reduce(lambda x, y: x & y, [dot(cross(minus(e, s), minus(p, s)), n) >= 0 for s, e in ((a, b), (b, c), (c, a))])
    plane = F.abs(dot(minus(p, a), n)) / size
    return F.when((size > 1e-14) & inside, plane).otherwise(F.least(edge(a, b), edge(b, c), edge(c, a)))


TRIANGLE = [f"{k}{x}" for k in "abc" for x in AXES]


#: Points and triangles of a block, at most; triangles that are met first; shares over which those are dealt, at most.
BLOCK, SHAPES, FIRST, DEALT = 4096, 131_072, 32_768, 32
#: Points and rays of a part that is not halved again, and triangles that are few enough to be tried one by one.
LEAF, RAYS, FEW = 128, 32, 256
#: Triangles of the first round over a block, growth of the rounds, and pairs that are tried at once.
ROUND, GROWTH, PAIRS = 2048, 8, 65_536


def _blocks(rows: DataFrame, by: list[str], columns: list[str], name: str, size: int) -> DataFrame:
    """(by, name): doubles of up to `size` rows of one group, as bytes; rows of a null group are left out."""
    kinds = dict(rows.dtypes)

    def blocks(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, part in pd.concat(held).groupby(by) if held else ():
            values = part[columns].to_numpy(float)
            for k in range(0, len(values), size):
                yield pd.DataFrame([(*group, values[k : k + size].tobytes())], columns=[*by, name])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= size:
                yield from blocks(held)
                held = []
        yield from blocks(held)

    return stored(rows.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], f"{name} binary"])), name)


def _met(rows: DataFrame, shapes: DataFrame, by: list[str], axes: list[str], value: str, least: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], every: bool) -> DataFrame:
    """(by, axes, value): what blocks of rows (axes, value so far) get from the blocks of shapes with their `_key`.

    A block goes to its key's task once, shapes before rows, so a task holds the shapes of one key and one block of rows. Rows that get
    no less than they have are left out unless `every` is set.
    """
    kinds = dict(rows.dtypes)
    keys = [*by, "_key"]
    both = shapes.select(*keys, F.lit(0).alias("_side"), F.col("shapes").alias("_held")).unionByName(rows.select(*keys, F.lit(1).alias("_side"), F.col("rows").alias("_held")))
    tasks = min(4096, 4 * max(1, shapes.select(*keys).distinct().count()))  # so that few keys share one
    both = both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, tri = None, [], None
        for b in batches:
            for *key, side, data in b[[*keys, "_side", "_held"]].itertuples(index=False):
                if key != at:
                    at, held, tri = key, [], None
                if side == 0:
                    held.append(np.frombuffer(data).reshape(-1, 9))
                    continue
                if held:
                    tri, held = np.concatenate(held), []
                r = np.frombuffer(data).reshape(-1, len(axes) + 1)
                got = r[:, -1] if tri is None else np.minimum(least(r[:, :-1], tri, r[:, -1]), r[:, -1])
                new = np.full(len(r), True) if every else got < r[:, -1]
                if new.any():
                    yield pd.DataFrame({**{c: [v] * int(new.sum()) for c, v in zip(by, key)}, **{x: r[new, i] for i, x in enumerate(axes)}, value: got[new]})

    return stored(both.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], *[f"{x} double" for x in axes], f"{value} double"])), value)


def _least_of_blocks(asked: DataFrame, tri: DataFrame, by: list[str], axes: list[str], value: str, least: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(by, axes, value): the least finite value of each row of asked over all triangles of its group, if there is one.

    Equal rows and equal triangles count once. Rows come in blocks of neighbours, triangles in blocks by hash. All rows meet some of their
    group's triangles first; those above 0 then meet the other blocks, over rounds of more and more blocks, with the value that they have,
    and `least` (rows, triangles, values) gives what is less. What goes to many tasks are rows, a few numbers each, and none at 0; blocks
    of triangles go to DEALT tasks at most, in rounds of few.
    """
    rows = stored(asked.select(*by, *axes).distinct(), "asked")
    shapes = stored(tri.select(*by, *TRIANGLE).distinct(), "shapes")
    sizes = stored(shapes.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    size = min(SHAPES, max(ROUND, -(-n // DEALT)))  # small tables give tasks too
    first = min(FIRST, size)
    sizes = sizes.select(*by, F.when(F.col("_n") > first, F.ceil(F.col("_n") / size)).otherwise(0).cast("int").alias("_blocks"), (first / F.col("_n")).alias("_share"))

    # key 0: the first triangles; a hash between 0 and 1 for that, another one for the rest
    at = (F.xxhash64(*TRIANGLE) / 2.0**64 + 0.5) >= F.col("_share")
    key = F.when((F.col("_blocks") > 0) & at, F.pmod(F.xxhash64(F.lit("block"), *TRIANGLE), F.col("_blocks")) + 1).otherwise(0).cast("int")
    keyed = shapes.join(sizes, by).withColumn("_key", key).select(*by, "_key", *TRIANGLE)
    shapes = _blocks(keyed.repartition(max(1, -(-n // size)), *by, "_key"), [*by, "_key"], TRIANGLE, "shapes", SHAPES)

    def meet(rows: DataFrame, shapes: DataFrame, n: int, every: bool) -> DataFrame:
        """rows (by, axes, value, _from, _to) with those of n keys of shapes; few keys are dealt over shares of the blocks of rows."""
        blocks = _blocks(rows.repartitionByRange(max(1, -(-rows.count() // BLOCK)), *by, *axes), [*by, "_from", "_to"], [*axes, value], "rows", BLOCK)
        shares = max(1, min(DEALT // n, blocks.count()))
        keyed = blocks.withColumn("_key", F.explode(F.sequence("_from", "_to"))).withColumn("_key", F.col("_key") * shares + F.pmod(F.xxhash64("rows"), F.lit(shares)).cast("int"))
        dealt = shapes.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("_key", F.col("_key") * shares + F.col("_share"))
        return _met(keyed, dealt, by, axes, value, least, every)

    none = F.lit(0)
    met = meet(rows.select("*", F.lit(math.inf).alias(value), none.alias("_from"), none.alias("_to")), shapes.where("_key = 0"), 1, True)
    done, most = 0, sizes.agg(F.max("_blocks")).first()[0] or 0
    step = 1 if size > FIRST else most  # rounds of small tables cost more than they save
    while done < most:
        span = F.lit(done + 1).alias("_from"), F.least(F.lit(done + step), "_blocks").alias("_to")
        left = met.groupBy(*by, *axes).agg(F.min(value).alias(value)).where(F.col(value) > 0).join(sizes.where(F.col("_blocks") > done), by)
        left = stored(left.select(*by, *axes, value, *span), "left")
        met = met.unionByName(meet(left, shapes.where(F.col("_key").between(done + 1, done + step)), min(step, most - done), False))
        done, step = done + step, step * GROWTH
    return met.where(F.col(value) < math.inf).groupBy(*by, *axes).agg(F.min(value).alias(value))


def _chunks(n: int) -> Iterator[slice]:
    """Ranges of rising length over n triangles: the first ones give bounds, by which most of the others are passed over."""
    at, size = 0, 8
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(2 * size, 256)


def _across(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cross products of rows; np.cross, without its checks, which take longer than short arrays."""
    (a, b, c), (x, y, z) = u.T, v.T
    return np.stack((b * z - c * y, c * x - a * z, a * y - b * x), 1)


def _halves(q: np.ndarray, ids: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of the points q in two halves, along the axis on which they lie farthest apart as a share of `whole`."""
    axis = np.argmax((q.max(0) - q.min(0)) / whole)
    order = np.argsort(q[:, axis], kind="stable")
    return ids[order[: len(ids) // 2]], ids[order[len(ids) // 2 :]]


def _planes(tri: np.ndarray) -> np.ndarray:
    """A column for each triangle: its normal, of length 1 or 0, and its offset, then the low and the high corner of its box."""
    normal = _across(tri[:, 3:6] - tri[:, :3], tri[:, 6:] - tri[:, :3])
    size = np.sqrt((normal * normal).sum(1))
    n = np.divide(normal, size[:, None], out=np.zeros_like(normal), where=size[:, None] > 0)
    corners = tri.reshape(-1, 3, 3)
    return np.concatenate((n.T, (n * tri[:, :3]).sum(1)[None], corners.min(1).T, corners.max(1).T))


def _rounding(p: np.ndarray, tri: np.ndarray) -> float:
    return 1e-12 * max(np.abs(p).max(), np.abs(tri).max())


def _least_distances(p: np.ndarray, tri: np.ndarray, limit: float, so_far: float | np.ndarray = np.inf) -> np.ndarray:
    """_distances of many points to many triangles, in growing rounds: what a point got bounds it in the next one; at 0 it is done.

    so_far: what points got from other triangles; what is not less than that by over 1e-12 of it may be left out.
    """
    best, at, size = np.full(len(p), np.inf), 0, ROUND
    bound = np.minimum(limit * (1 + 1e-9), np.broadcast_to(so_far, len(p)))
    margin = _rounding(p, tri)
    while at < len(tri):
        size = size if len(tri) - at >= 2 * size else len(tri)
        left = np.flatnonzero(best > 0)
        if not len(left):
            break
        best[left] = np.minimum(best[left], _halved_distances(p[left], tri[at : at + size], np.minimum(bound, best)[left], margin))
        at, size = at + size, size * GROWTH
    return np.where(best <= limit, best, np.inf)


def _halved_distances(p: np.ndarray, tri: np.ndarray, bound: np.ndarray, margin: float) -> np.ndarray:
    """_tried by parts: points are halved into smaller and smaller parts, each with the triangles near it.

    A part's box is farther from a triangle's plane than its centre is less half its sides along the normal, and as far from its box
    as both boxes lie apart. All its points are as near to a triangle as its centre is plus its radius, or have a bound.
    """
    best = np.full(len(p), np.inf)
    parts = [(np.arange(len(p)), np.arange(len(tri)), _planes(tri), np.inf, p[0])]
    while parts:
        ids, near, s, nearest, before = parts.pop()
        q = p[ids]
        if len(near) > FEW:
            lo, hi = q.min(0), q.max(0)
            at, half = (lo + hi) / 2, (hi - lo) / 2
            r, most, slopes = np.sqrt((half * half).sum()), bound[ids].max(), np.abs(s[:3])
            nearest += np.sqrt(((at - before) ** 2).sum())
            off = np.abs(at @ s[:3] - s[3])
            apart = np.maximum(np.maximum(s[4:7] - hi[:, None], lo[:, None] - s[7:]), 0)
            apart = np.sqrt((apart * apart).sum(0))
            if nearest + r > most / 2:
                some = np.argpartition(np.maximum(off, apart), FEW // 4)[: FEW // 4]
                nearest = min(nearest, _heights(at[None], tri[near[some]], s[:3, some]).min())
            reach = min(most, (nearest + r) * (1 + 1e-9) + margin)
            keep = np.flatnonzero((off - half @ slopes <= reach * (1 + 1e-6) + margin) & (apart <= reach * (1 - 1e-12)))
            halve = len(ids) > LEAF and len(keep) > FEW
            if not halve and len(keep) > FEW:
                keep = keep[np.argpartition(np.maximum(off, apart)[keep], FEW)]
            near, s = near[keep], s.take(keep, 1)
            if halve:
                parts += [(part, near, s, nearest, at) for part in _halves(q, ids, 1 / (slopes.mean(1) + 0.05))]
                continue
        if len(near):
            best[ids] = _tried(q, tri, near, s, bound[ids], margin)
    return best


def _heights(p: np.ndarray, tri: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distance of each point to its triangle, whose normal is a column of n: over the inside by the height over its plane, else to the
    nearest edge."""
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    turn = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    a, b, c = np.ascontiguousarray(tri.T).reshape(3, 3, -1)
    to, b, c = p.T - a, b - a, c - a
    normal = turn(b, c)
    bb, bc, cc, pb, pc, pp, h = dot(b, b), dot(b, c), dot(c, c), dot(to, b), dot(to, c), dot(to, to), dot(to, n)

    def edge(pp, d, length):  # pp: square of the way from the edge's start, d: its product with the edge
        t = np.clip(np.divide(d, length, out=np.zeros_like(d), where=length > 0), 0, 1)
        return pp - 2 * t * d + t * t * length

    over = np.sqrt(dot(normal, normal)) > 1e-14
    for side, way in ((b, to), (c - b, to - b), (-c, to - c)):
        over &= dot(turn(side, way), normal) >= 0
    edges = np.minimum(np.minimum(edge(pp, pb, bb), edge(pp, pc, cc)), edge(pp - 2 * pb + bb, pc - pb - bc + bb, cc - 2 * bc + bb))
    return np.sqrt(np.maximum(np.where(over, h * h, edges), 0))


def _tried(p: np.ndarray, tri: np.ndarray, near: np.ndarray, s: np.ndarray, bound: np.ndarray, margin: float) -> np.ndarray:
    """Distance from each point to the nearest of the triangles `near`, with their _planes s, if it is below the bound.

    Planes farther than the nearest triangle so far are passed over, then boxes; what is left is measured. Points at 0 are done.
    """
    best = np.full(len(p), np.inf)
    active = np.arange(len(p))
    at, size = 0, 8
    while at < len(near) and len(active):
        w = slice(at, at + size)
        q, reach = p[active], np.minimum(best[active], bound[active])
        i, j = np.nonzero(np.abs(q @ s[:3, w] - s[3, w]) <= (reach * (1 + 1e-6) + margin)[:, None])
        j += at
        reach *= 1 - 1e-12
        for x in range(3):
            inside = (q[i, x] >= s[4 + x, j] - reach[i]) & (q[i, x] <= s[7 + x, j] + reach[i])
            i, j = i[inside], j[inside]
        if len(i):
            d = _heights(q[i], tri[near[j]], s[:3, j])
            d[d <= margin] = 0  # the rounding of coordinates
            np.minimum.at(best, active[i], d)
        at, size = at + size, min(2 * size, max(256, PAIRS // len(active)))
        active = active[best[active] > 0]
    return best


def _distances(p: np.ndarray, tri: np.ndarray, limit: float) -> np.ndarray:
    """Distance from each point to the nearest of the triangles; infinite if none is within limit."""
    best = _tried(p, tri, np.arange(len(tri)), _planes(tri), np.full(len(p), limit * (1 + 1e-9)), _rounding(p, tri))
    return np.where(best <= limit, best, np.inf)


def point_mesh_distance(pts: DataFrame, tri: DataFrame, by: list[str], key: str, limit: float) -> DataFrame:
    """(by, key, distance): distance from each point to its mesh, up to `limit`; null if nothing is that near.

    Points at one place are one, and so are equal triangles (ax .. cz); work grows with places and different triangles. Coordinates
    that are null or not finite have no distance.
    """
    place = [f"_{x}" for x in AXES]
    asked = pts.select(*by, key, *[(F.col(x).cast("double") + F.lit(0.0)).alias(c) for x, c in zip(AXES, place)])
    near = _least_of_blocks(asked.where(finite(tuple(place))), tri.where(finite(tuple(TRIANGLE))), by, place, "distance", lambda p, t, so_far: _least_distances(p, t, limit, so_far))
    near = asked.join(near, [*by, *place]).groupBy(*by, key).agg(F.min("distance").alias("distance"))
    return pts.select(*by, key).join(near, [*by, key], "left")


def _depths(d: np.ndarray, tri: np.ndarray, slack: float) -> np.ndarray:
    """Depth of the first hit of each ray (dx, dy, -1) with the triangles, all with z < 0; infinite without one.

    The nearest triangles come first; rays that met something nearer than a triangle's nearest corner pass it over.
    """
    nearest = -tri[:, 2::3].max(1)
    order = np.argsort(nearest, kind="stable")
    tri, nearest = tri[order], nearest[order]
    flat = tri.reshape(-1, 3, 3)[:, :, :2] / -tri.reshape(-1, 3, 3)[:, :, 2:]
    low, high = flat.min(1) - slack, flat.max(1) + slack
    seen = ((low <= d.max(0)) & (high >= d.min(0))).all(1)
    tri, nearest, low, high = tri[seen], nearest[seen], low[seen], high[seen]
    a, e1, e2 = tri[:, :3], tri[:, 3:6] - tri[:, :3], tri[:, 6:] - tri[:, :3]
    # what a test needs of a triangle is linear in the ray's direction: det, u det and v det; and t det is a number
    det_, u_, v_ = np.cross(e2, e1), np.cross(e2, -a), np.cross(-a, e1)
    top = (e2 * v_).sum(1)
    best = np.full(len(d), np.inf)
    for at in _chunks(len(tri)):
        active = np.flatnonzero(best > nearest[at.start] * (1 - 1e-9))
        if not len(active):
            break
        q = d[active]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            det = q[:, :1] * det_[at, 0] + q[:, 1:] * det_[at, 1] - det_[at, 2]
            t = top[at] / det
            i, k = np.nonzero((np.abs(det) > 1e-14) & (t > 0) & (t < best[active][:, None]))
            j, det, t, x, y = k + at.start, det[i, k], t[i, k], q[i, 0], q[i, 1]
            along = lambda m: (x * m[j, 0] + y * m[j, 1] - m[j, 2]) / det
            u, v = along(u_), along(v_)
            hit = (u >= 0) & (v >= 0) & (u + v <= 1) & (x >= low[j, 0]) & (x <= high[j, 0]) & (y >= low[j, 1]) & (y <= high[j, 1])
        np.minimum.at(best, active[i[hit]], t[hit])
    return best


def _first_depths(d: np.ndarray, tri: np.ndarray, slack: float, so_far: float | np.ndarray = np.inf) -> np.ndarray:
    """_depths of many rays and triangles: rays are halved into smaller and smaller parts, each with the triangles that it may hit first.

    Over a part's box of directions 1 / depth and the tests for the sides are linear, so their bounds are known. A triangle goes if it
    lies outside the box, or nowhere before the farthest depth of another that covers the whole box or of what the rays met so far.
    """
    corners = tri.reshape(-1, 3, 3)
    flat = corners[:, :, :2] / -corners[:, :, 2:]
    low, high, nearest = flat.min(1) - slack, flat.max(1) + slack, -corners[:, :, 2].max(1)
    a, e1, e2 = tri[:, :3], tri[:, 3:6] - tri[:, :3], tri[:, 6:] - tri[:, :3]
    det_, u_, v_ = np.cross(e2, e1), np.cross(e2, -a), np.cross(-a, e1)
    top = (e2 * v_).sum(1)
    turn = np.where(top < 0, -1.0, 1.0)[:, None]  # a hit has depth > 0, so det has the sign of top
    top, sides = np.abs(top), np.stack([turn * m for m in (det_, u_, v_, det_ - u_ - v_)], 1)
    slip = 1e-9 * np.abs(sides).sum((1, 2)) * max(1.0, np.abs(d).max())
    best, so_far = np.full(len(d), np.inf), np.broadcast_to(so_far, len(d))
    whole = np.maximum(d.max(0) - d.min(0), 1e-300)
    parts = [(np.arange(len(d)), np.arange(len(tri)))]
    while parts:
        ids, near = parts.pop()
        q = d[ids]
        if len(near) > FEW:
            lo, hi = q.min(0), q.max(0)
            near = near[((low[near] <= hi) & (high[near] >= lo)).all(1)]
            (x, y), (w, h) = (lo + hi) / 2, (hi - lo) / 2
            s = sides[near]
            mid, spread = s[:, :, 0] * x + s[:, :, 1] * y - s[:, :, 2], np.abs(s[:, :, 0]) * w + np.abs(s[:, :, 1]) * h
            least, most = mid - spread, mid + spread
            err = slip[near]
            over = (least > err[:, None]).all(1) & (least[:, 0] > 1e-12)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                far = np.min(top[near][over] / least[over, 0], initial=so_far[ids].max())
                first = np.where(most[:, 0] > err, np.maximum(nearest[near], top[near] / (most[:, 0] + err)), nearest[near])
            meets = (most[:, 1:] >= -err[:, None]).all(1) & (first <= far * (1 + 1e-9))
            near = near[meets]
            if len(ids) > RAYS and len(near) > FEW:
                parts += [(half, near) for half in _halves(q, ids, whole)]
                continue
        if len(near):
            best[ids] = _depths(q, tri[near], slack)
    return best


def first_hits(rays: DataFrame, tri: DataFrame, by: list[str], key: str, tile: float) -> DataFrame:
    """(by, key, depth): nearest hit of rays from the origin through (dx, dy, -1) with triangles (ax .. cz); null without a hit.

    Rays of one direction are one, and so are equal triangles. A triangle is tried where its plane is met before the nearest hit
    so far; a hit lies in its projected box, but for rounding, 1e-9 of `tile`. Triangles that are not all in front
    (z < 0) or have a coordinate that is null or not finite are not hit, nor do rays without finite directions hit.
    """
    front = (F.col("az") < 0) & (F.col("bz") < 0) & (F.col("cz") < 0)
    way = ["_dx", "_dy"]
    asked = rays.select(*by, key, *[(F.col(c[1:]).cast("double") + F.lit(0.0)).alias(c) for c in way])
    near = _least_of_blocks(asked.where(finite(tuple(way))), tri.where(finite(tuple(TRIANGLE)) & front), by, way, "depth", lambda d, t, so_far: _first_depths(d, t, tile * 1e-9, so_far))
    near = asked.join(near, [*by, *way]).groupBy(*by, key).agg(F.min("depth").alias("depth"))
    return rays.select(*by, key).join(near, [*by, key], "left")


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Sum of value up to each row in order of a whole-number column, over blocks, so that a large group lies in many tasks."""
    rows = df.withColumn("_b", F.floor(F.col(order) / block))
    sums = rows.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_s").over(w) - F.col("_s")).drop("_s")
    own = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_own", own).join(sums, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")
