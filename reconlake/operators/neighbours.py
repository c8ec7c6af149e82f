"""Exact nearest neighbours over points of any density: a tree of cells with few sites each, visited by bounds on the distance.

A group with few sites is one cell. A larger one is cut at quantiles of its sites along the axis in which they spread most, its
parts again, until a cell has few. Cells, and the boxes of what lies in them, are tables; so the tree of a large group is as
distributed as its points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

AXES = ("x", "y", "z")
#: Sites of a cell, about; no cell has over twice as many.
CELL = 64
#: Most parts that a cell is cut into at once.
PARTS = 64


def finite(axes: tuple[str, ...]) -> Column:
    """True where all coordinates are numbers: neither null nor NaN nor infinite."""
    return F.coalesce(reduce(lambda p, q: p & q, [F.abs(F.col(x)) < float("inf") for x in axes]), F.lit(False))


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [d * d for d in parts]))


def _cut(rows: DataFrame, by: list[str], axes: tuple[str, ...], cell: int, left: int) -> DataFrame:
    """(by, node, axis, splits): rising values that part the sites of a node into about (n / cell)^(1 / left) parts.

    The axis is the one with the widest middle range of quantiles. Distinct sites can't share most values on all axes, so it has two
    different quantiles, and some split lies above its smallest value: each cut leaves two parts with sites at least.
    """
    fractions = [k / PARTS for k in range(1, PARTS)]
    q = rows.groupBy(*by, "node").agg(F.max("n").alias("n"), *[F.percentile_approx(x, fractions, 20 * PARTS).alias(f"q{x}") for x in axes])
    spread = lambda x: F.element_at(f"q{x}", -1) - F.element_at(f"q{x}", 1)
    widest = F.greatest(*[spread(x) for x in axes]) if len(axes) > 1 else spread(axes[0])
    axis = F.coalesce(*[F.when(spread(x) == widest, F.lit(k)) for k, x in enumerate(axes)])
    q = q.withColumn("axis", axis).withColumn("q", F.element_at(F.array(*[f"q{x}" for x in axes]), F.col("axis") + 1))
    parts = F.least(F.lit(PARTS), F.greatest(F.lit(2), F.ceil(F.pow(F.col("n") / cell, F.lit(1 / left))))).cast("int")
    some = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.element_at("q", F.floor(k * PARTS / parts).cast("int")))
    above = F.filter(F.array_distinct(some), lambda s: s > F.element_at("q", 1))
    return q.select(*by, "node", "axis", F.when(F.size(above) > 0, above).otherwise(F.array(F.element_at("q", -1))).alias("splits"))


def _placed(sites: DataFrame, by: list[str], axes: tuple[str, ...], cell: int) -> tuple[DataFrame, int]:
    """sites with the path of their cell (`node`, as in "3.17."), and the length of the longest path."""
    todo, done, depth = sites.withColumn("node", F.lit("")), [], 0
    while True:
        sizes = todo.groupBy(*by, "node").agg(F.count("*").alias("n"))
        large = stored(sizes.where(F.col("n") > 2 * cell), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, todo]), depth
        done.append(todo.join(large, [*by, "node"], "left_anti"))
        crowd = todo.join(large, [*by, "node"])
        splits = _cut(crowd, by, axes, cell, max(1, len(axes) - depth))
        at = F.element_at(F.array(*axes), F.col("axis") + 1)
        part = F.size(F.filter("splits", lambda s: s <= at))
        moved = crowd.drop("n").join(splits, [*by, "node"]).withColumn("node", F.concat("node", part.cast("string"), F.lit(".")))
        todo, depth = stored(moved.select(*todo.columns), "placed"), depth + 1


def _to_box(axes: tuple[str, ...], box: Column) -> Column:
    """Distance from a point to a box, 0 inside; not more than the distance to any site in it, also after rounding."""
    return _length([F.greatest(box[f"lo{x}"] - F.col(x), F.col(x) - box[f"hi{x}"], F.lit(0.0)) for x in axes])


def _nodes(leaves: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    """(by, node, parts): for each cell that was cut, its parts with their boxes; PARTS at most."""
    way = F.filter(F.split("node", "[.]"), lambda p: p != "")
    path = lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(way, F.lit(1), n), "."), F.lit(".")))
    edges = leaves.where("node <> ''").select(*by, *[f"{e}{x}" for x in axes for e in ("lo", "hi")], way.alias("way"), F.explode(F.sequence(F.lit(0), F.size(way) - 1)).alias("k"))
    way = F.col("way")
    edges = edges.withColumns({"parent": path(F.col("k")), "part": path(F.col("k") + 1)})
    boxes = edges.groupBy(*by, "parent", "part").agg(*[f(f"{e}{x}").alias(f"{e}{x}") for x in axes for e, f in (("lo", F.min), ("hi", F.max))])
    return boxes.groupBy(*by, F.col("parent").alias("node")).agg(F.collect_list(F.struct("part", *[f"{e}{x}" for x in axes for e in ("lo", "hi")])).alias("parts"))


def nn_join(a: DataFrame, b: DataFrame, by: list[str], key: str, other: str, axes: tuple[str, ...] = AXES, cell: int = CELL) -> DataFrame:
    """(by, key, distance, other): for each point of a the nearest point of b in its group, ties to the smaller id; exact.

    Each point goes down to one cell, always to the nearest box, and takes the nearest site there. Then it visits all other cells
    whose box is within that distance. Sites of a cell are one row, so a step is a join with one row a visited cell and no group of
    points or sites comes together in one task. Points of b at one place count once, with the smallest id.

    Points of a that have a coordinate that is null or not finite, or whose group (or a part of its key) is null or has no site, get
    nulls; such points of b don't count. Rows of a with the same group and key count as one, with the nearest of their neighbours.
    """
    kinds = dict(b.dtypes)
    sites = stored(b.where(finite(axes)).groupBy(*by, *[F.col(x).cast("double").alias(x) for x in axes]).agg(F.min(other).alias("o")), "sites")
    placed, depth = _placed(sites, by, axes, cell)
    leaves = placed.groupBy(*by, "node").agg(F.collect_list(F.struct(*axes, "o")).alias("sites"), *[f(x).alias(f"{e}{x}") for x in axes for e, f in (("lo", F.min), ("hi", F.max))])
    leaves = stored(leaves, "leaves")
    cells = leaves.select(*by, "node", "sites")
    nearest = F.array_min(F.transform("sites", lambda s: F.struct(_length([F.col(x) - s[x] for x in axes]).alias("d"), s["o"].alias("o"))))

    points = a.select(*by, F.col(key).alias("_key"), *[F.col(x).cast("double").alias(x) for x in axes])
    at = points.where(finite(axes)).withColumn("node", F.lit(""))
    nodes = stored(_nodes(leaves, by, axes), "nodes") if depth else None
    for _ in range(depth):
        best = F.array_min(F.transform("parts", lambda p: F.struct(_to_box(axes, p).alias("d"), p["part"].alias("part"))))["part"]
        at = at.join(nodes, [*by, "node"], "left").withColumn("node", F.coalesce(best, "node")).drop("parts")
    first = at.join(cells, [*by, "node"], "left").withColumn("near", nearest).drop("sites")
    if depth:
        first = stored(first, "nearest")
        asked = first.where("near.d is not null").select(*by, "_key", *axes, F.col("near.d").alias("_d"), F.col("node").alias("_first"), F.lit("").alias("node"))
        for _ in range(depth):
            within_reach = F.transform(F.filter("parts", lambda p: _to_box(axes, p) <= F.col("_d")), lambda p: p["part"])
            asked = asked.join(nodes, [*by, "node"], "left").withColumn("node", F.explode(F.coalesce(within_reach, F.array("node")))).drop("parts")
        more = asked.where("node <> _first").join(cells, [*by, "node"]).select(*by, "_key", nearest.alias("near"))
        first = first.select(*by, "_key", "near").unionByName(more)
    found = first.select(*by, "_key", "near").unionByName(points.where(~finite(axes)).select(*by, "_key", F.lit(None).cast(dict(first.dtypes)["near"]).alias("near")))
    out = found.groupBy(*by, "_key").agg(F.min("near").alias("near"))
    return out.select(*by, F.col("_key").alias(key), F.col("near.d").alias("distance"), F.col("near.o").cast(kinds[other]).alias(other))


def within(a: DataFrame, b: DataFrame, by: list[str], r: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Points of a that have a point of b of their group within r. All columns and repeated rows stay."""
    place = F.struct(*[F.col(c) for c in (*by, *axes)])
    asked = a.select(*by, *axes).distinct().withColumn("_p", place)
    hit = nn_join(asked, b.select(*by, *axes, F.lit(0).alias("_o")), by, "_p", "_o", axes).where(F.col("distance") <= r).select("_p")
    return a.withColumn("_p", place).join(hit, "_p", "left_semi").drop("_p")
