"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node that it reaches.

    Alternates large-star and small-star rounds until the edges no longer change. Minima are combined before the shuffle
    and joined back to the edges, so that a hub's edges may lie in many tasks. Null ends and self loops give no edge;
    an empty table gives an empty table.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b"))
    e = stored(e.where("a is not null and b is not null and a <> b").select("u", "v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        e = stored(small.distinct(), "small-star")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = out.select(F.col("component").alias("node"), F.col("component")).distinct()
    return out.unionByName(roots)
