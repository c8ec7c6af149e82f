"""Exact quantiles of groups of any size: ranks are closed in on by sketches, counted exactly, until few values are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.plans.lineage import stored

#: Values that one task sorts, or holds the counts of, at most.
SMALL = 1 << 16
#: Steps of the sketch that a pass cuts an interval into; values between two steps that enclose a rank go on.
STEPS = 512
#: Rows up to which a table of groups is broadcast; a larger one is shuffled.
SHARED = 100_000


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a stored table of groups, null keys equal to each other; a table of up to SHARED rows is broadcast."""
    named = table.withColumnsRenamed({k: f"_t{k}" for k in keys})
    if table.limit(SHARED + 1).count() <= SHARED:
        named = F.broadcast(named)
    return rows.join(named, reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in keys]), how).drop(*[f"_t{k}" for k in keys])


def _inside(v: Column) -> Column:
    return F.coalesce(v > F.col("lo"), F.lit(True)) & F.coalesce(v < F.col("hi"), F.lit(True))


def _ranks(rows: DataFrame, large: DataFrame, keys: list[str], ranks: DataFrame, small: int) -> DataFrame:
    """(keys, r, v): the value of rank r, from 0, of each group in `ranks` (keys, r).

    A rank is known to lie in an open interval (lo, hi) of `inside` values with `before` values below. Two values of a sketch around
    it part the interval in five, whose values are counted: below, equal to, between, equal to and above the two. Equal values end
    the search; an open part is smaller than the interval, so this ends whatever the values are and however good the sketch is.
    """
    none = F.lit(None).cast("double")
    todo = _meet(ranks, large, keys).select(*keys, "r", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    todo, found = stored(todo, "ranks"), []
    place = Window.partitionBy(*keys, "r").orderBy("v")
    while True:
        few = todo.where(F.col("inside") <= small)
        if not few.isEmpty():
            near = _meet(rows, few, keys).where(_inside(F.col("v")))
            near = near.withColumn("place", F.row_number().over(place) - 1).where(F.col("place") == F.col("r") - F.col("before"))
            found.append(stored(near.select(*keys, "r", "v"), "found"))
        many = todo.where(F.col("inside") > small)
        if many.isEmpty():
            return reduce(DataFrame.unionByName, found)
        parts = stored(many.select(*keys, "lo", "hi").distinct(), "intervals")
        steps = _meet(rows, parts, keys).where(_inside(F.col("v"))).groupBy(*keys, "lo", "hi").agg(F.percentile_approx("v", [k / STEPS for k in range(STEPS + 1)], 10 * STEPS).alias("q"))
        steps = stored(steps.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), "steps")
        at = (F.col("r") - F.col("before")) / F.col("inside") * STEPS
        enclosing = _meet(many, steps, keys).where(F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi")))
        a, b = F.get("q", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")), F.get("q", F.least(F.ceil(at) + 1, F.lit(STEPS)).cast("int"))
        enclosing = stored(enclosing.withColumns({"a": a, "b": b}).drop("q", "_lo", "_hi"), "pivots")
        v = F.col("v")
        tests = {"below": v < F.col("a"), "at_a": v == F.col("a"), "between": (v > F.col("a")) & (v < F.col("b")), "at_b": (v == F.col("b")) & (v > F.col("a"))}
        state = [*keys, "r", "lo", "hi", "before", "inside", "a", "b"]
        counts = _meet(rows, enclosing, keys).where(_inside(v)).groupBy(*state).agg(*[F.count_if(t).alias(c) for c, t in tests.items()])
        c1 = F.col("below")
        c2, c3, c4 = c1 + F.col("at_a"), c1 + F.col("at_a") + F.col("between"), c1 + F.col("at_a") + F.col("between") + F.col("at_b")
        k = F.col("r") - F.col("before")
        part = F.when(k < c1, 0).when(k < c2, 1).when(k < c3, 2).when(k < c4, 3).otherwise(4)
        parted = stored(counts.withColumn("part", part), "parted")
        p = F.col("part")
        found.append(parted.where("part in (1, 3)").select(*keys, "r", F.when(p == 1, F.col("a")).otherwise(F.col("b")).alias("v")))
        narrower = {
            "lo": F.when(p == 0, F.col("lo")).when(p == 2, F.col("a")).otherwise(F.col("b")),
            "hi": F.when(p == 0, F.col("a")).when(p == 2, F.col("b")).otherwise(F.col("hi")),
            "before": F.col("before") + F.when(p == 0, F.lit(0)).when(p == 2, c2).otherwise(c4),
            "inside": F.when(p == 0, c1).when(p == 2, F.col("between")).otherwise(F.col("inside") - c4),
        }
        todo = stored(parted.where("part in (0, 2, 4)").select(*keys, "r", *[c.alias(n) for n, c in narrower.items()]), "ranks")


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], small: int = SMALL) -> DataFrame:
    """(by, a double for each name of qs): exact quantiles, between two ranks on the line through their values.

    One row for each group of df, null keys are a group; null values don't count, and a group without others has nulls; NaN is above all
    numbers. Groups of up to `small` values are taken at once; ranks of larger ones are closed in on over passes, each of which
    holds sketches and counts only.
    """
    keys = [f"_g{k}" for k in range(max(1, len(by)))]
    group = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias(keys[0])]
    rows = stored(df.select(*group, F.col(value).cast("double").alias("v")), "values")
    large = rows.groupBy(*keys).agg(F.count("v").alias("n")).where(F.col("n") > small)
    direct = lambda r: r.groupBy(*keys).agg(*[F.percentile("v", F.lit(float(q))).alias(f"_q{k}") for k, q in enumerate(qs.values())])
    names = [F.col(k).alias(c) for k, c in zip(keys, by)] + [F.col(f"_q{k}").alias(name) for k, name in enumerate(qs)]
    large = stored(large, "large")
    if large.isEmpty():
        return direct(rows).select(*names)
    rest = _meet(rows, large.drop("n"), keys, "left_anti")
    rows = rows.where("v is not null")
    h = lambda q: (F.col("n") - 1) * F.lit(float(q))
    wanted = [F.struct(F.lit(k).alias("k"), h(q).alias("h"), f(h(q)).cast("long").alias("r")) for k, q in enumerate(qs.values()) for f in (F.floor, F.ceil)]
    wanted = stored(large.select(*keys, F.inline(F.array(*wanted))).distinct(), "wanted")
    got = stored(_ranks(rows, large, keys, wanted.select(*keys, "r").distinct(), small), "values")
    both = _meet(wanted, got.withColumnRenamed("r", "_r"), keys).where(F.col("r") == F.col("_r"))
    both = both.groupBy(*keys, "k", "h").agg(F.min_by("v", "r").alias("low"), F.max_by("v", "r").alias("high"))
    share = F.col("h") - F.floor("h")
    both = both.withColumn("q", F.when((share == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high")))
    picked = both.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"_q{k}") for k in range(len(qs))])
    out = picked.unionByName(direct(rest)) if by else picked
    return out.select(*names)


def with_quantiles(aggregates: DataFrame, df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """aggregates, one row a group, with quantiles of df's value; null keys meet."""
    q = quantiles(df, by, value, qs).withColumnsRenamed({c: f"_q_{c}" for c in by})
    on = reduce(lambda p, r: p & r, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], F.lit(True))
    return aggregates.join(q, on, "left").drop(*[f"_q_{c}" for c in by])
