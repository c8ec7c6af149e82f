"""Paired contrasts and cluster bootstraps. Draws are hashes of (seed, replicate, block), so they don't depend on partitioning.

Units (objects, scenes, families) lie in blocks; a task that has a block works out how often each of its units is drawn in each
replicate and adds to one pair of sums a replicate. So nothing that grows with units times replicates is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.operators.quantiles import quantiles
from reconlake.plans.lineage import stored
from reconlake.plans.ordinals import numbered

#: Units of a block.
BLOCK = 4096


def paired(scores: DataFrame, left: str, right: str, keys: list[str], arm: str = "arm", value: str = "value") -> DataFrame:
    """One row a key that both arms have: left, right and their difference (null if one is undefined)."""
    of = lambda k: F.max(F.when(F.col(arm) == k, F.col(value)))
    has = lambda k: F.count_if(F.col(arm) == k) > 0
    rows = scores.where(F.col(arm).isin(left, right)).groupBy(*keys).agg(of(left).alias("left"), of(right).alias("right"), (has(left) & has(right)).alias("_both"))
    return rows.where("_both").drop("_both").withColumn("difference", F.col("left") - F.col("right"))


def _drawn(seed: str, replicate: int, block: int, draws: int, units: int) -> np.ndarray:
    """How often each of `units` is met in so many draws: 32 bits each, eight from one SHA-256 of seed, replicate, block and number."""
    raw = b"".join(hashlib.sha256(f"{seed}/{replicate}/{block}/{k}".encode()).digest() for k in range(-(-draws // 8)))
    return np.bincount(np.frombuffer(raw, ">u4")[:draws] % units, minlength=units)


def _share(seed: str, replicate: int, block: int, units: int, size: int) -> int:
    """How many of a replicate's draws, as many as units, fall into a block of `size` units: halves of the blocks share what falls into
    both binomially, down to the block. Each task finds the same numbers, and those of all blocks add up."""
    low, high, draws = 0, -(-units // size), units
    while high - low > 1:
        middle = (low + high) // 2
        part = (middle - low) * size / (min(high * size, units) - low * size)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}/{replicate}/{low}-{high}".encode()).digest()[:8], "big"))
        left = int(rng.binomial(draws, part))
        low, high, draws = (low, middle, left) if block < middle else (middle, high, draws - left)
    return draws


def _replicates(cells: DataFrame, unit: str, replicates: int, seed: str, other: str | None = None, size: int = BLOCK) -> tuple[DataFrame, int, int]:
    """(replicate, m): the ratio of summed num to summed den over units drawn with replacement, and how many units (and others) there are.

    cells: unit, other, num, den; with `other`, its values are drawn too and a cell counts as often as the product of both. Units lie in
    blocks of `size`, in their order; a task works out how often its block's units are drawn and keeps two sums a replicate. Others, as
    training seeds, are few: more than BLOCK are refused.
    """

    def placed(column: str, name: str) -> tuple[DataFrame, int]:
        units = numbered(cells.select(F.col(column).alias("_u")).distinct(), ["_u"], name)
        return units, units.count()

    cells = stored(cells, "cells")
    units, n = placed(unit, "_slot")
    rows, n_other = cells.join(units, F.col(unit).eqNullSafe(F.col("_u"))).drop("_u").withColumn("_other", F.lit(0)), 1
    if other is not None:
        others, n_other = placed(other, "_other")
        if n_other > BLOCK:
            raise ValueError(f"{other} has over {BLOCK} values")
        rows = rows.drop("_other").join(others, F.col(other).eqNullSafe(F.col("_u"))).drop("_u")
    item = F.struct((F.col("_slot") % size).cast("int").alias("slot"), F.col("_other").cast("int").alias("other"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    blocks = rows.groupBy(F.floor(F.col("_slot") / size).alias("block")).agg(F.collect_list(item).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, replicates))
        for b in batches:
            for block, own in zip(b.column(0).to_pylist(), b.column(1)):
                slot, k, num, den = (own.values.field(c).to_numpy() for c in ("slot", "other", "num", "den"))
                here = min(size, n - block * size)
                for r in range(replicates):
                    times = _drawn(seed + "/units", r, block, _share(seed + "/units", r, block, n, size), here)[slot]
                    if other is not None:
                        times = times * _drawn(seed + "/others", r, 0, n_other, n_other)[k]
                    sums[0, r] += times @ num
                    sums[1, r] += times @ den
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *map(pa.array, sums)], names=["replicate", "num", "den"])

    sums = blocks.mapInArrow(run, "replicate long, num double, den double").groupBy("replicate").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return sums.select("replicate", F.try_divide("num", "den").alias("m")), n, n_other


def _interval(means: DataFrame) -> DataFrame:
    """Low and high of the middle 95 % of as many values as there are replicates; one row, joined by _k."""
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.lit(0).alias("_k"))


def bootstrap_objects(diffs: DataFrame, obj: str = "object_id", value: str = "difference", replicates: int = 10000, seed: str = "objects") -> DataFrame:
    """Object-balanced mean difference with its 95 % interval over resampled objects; undefined differences are left out.

    One row: mean, low, high, objects, observations. Without any defined difference all but the counts are null.
    """
    units = stored(diffs.where(F.col(value).isNotNull()).groupBy(obj).agg(F.avg(value).alias("num"), F.count("*").alias("n")), "units")
    means, n, _ = _replicates(units.select(obj, "num", F.lit(1.0).alias("den")), obj, replicates, seed)
    whole = units.agg(F.avg("num").alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.lit(0).alias("_k"))
    return whole.join(_interval(means), "_k").select("mean", "low", "high", F.lit(n).cast("long").alias("objects"), "observations")


def bootstrap_crossed(diffs: DataFrame, obj: str = "object_id", seed_col: str = "seed", value: str = "difference", replicates: int = 10000, seed: str = "crossed") -> DataFrame:
    """Interval over objects and training seeds drawn independently; a replicate's mean is over all drawn pairs.

    How often each object and seed was drawn multiplies into the weight of their cell, so pairs aren't expanded.
    """
    cells = stored(diffs.where(F.col(value).isNotNull()).groupBy(obj, seed_col).agg(F.avg(value).alias("num")).withColumn("den", F.lit(1.0)), "cells")
    means, n, seeds = _replicates(cells, obj, replicates, seed, seed_col)
    whole = cells.agg(F.avg("num").alias("mean"), F.lit(0).alias("_k"))
    return whole.join(_interval(means), "_k").select("mean", "low", "high", F.lit(n).cast("long").alias("objects"), F.lit(seeds).cast("long").alias("seeds"))


def bootstrap_scenes(diffs: DataFrame, obj: str = "object_id", scene: str = "scene_id", value: str = "difference", replicates: int = 10000, seed: str = "scenes") -> DataFrame:
    """Interval over scenes drawn as clusters: ratio of summed weighted differences to summed weights.

    A row's weight is one over its object's rows, so objects count alike in the whole.
    """
    rows = diffs.where(F.col(value).isNotNull())
    per = rows.groupBy(obj).agg((1 / F.count("*")).alias("_w"))
    units = stored(rows.join(per, obj).groupBy(scene).agg(F.sum(F.col("_w") * F.col(value)).alias("num"), F.sum("_w").alias("den")), "units")
    means, n, _ = _replicates(units, scene, replicates, seed)
    whole = units.agg(F.try_divide(F.sum("num"), F.sum("den")).alias("mean"), F.lit(0).alias("_k"))
    return whole.join(_interval(means), "_k").select("mean", "low", "high", F.lit(n).cast("long").alias("scenes"))


def bootstrap_families(diffs: DataFrame, family: str, seed_col: str = "seed", obj: str = "object_id", value: str = "difference", replicates: int = 10000, seed: str = "families") -> DataFrame:
    """Crossed bootstrap with families as units, objects averaged within them first."""
    objects = diffs.groupBy(family, obj, seed_col).agg(F.avg(value).alias(value))
    return bootstrap_crossed(objects, family, seed_col, value, replicates, seed)


def contrasts(scores: DataFrame, pairs: list[tuple[str, str]], by: list[str], keys: list[str], obj: str = "object_id", arm: str = "arm", value: str = "value") -> DataFrame:
    """For every pair of arms and group (population, budget): object-balanced difference, objects, samples and signs."""
    out = None
    for left, right in pairs:
        d = paired(scores, left, right, [*by, obj, *keys], arm, value)
        objects = d.where("difference is not null").groupBy(*by, obj).agg(F.avg("difference").alias("_m"), F.count("*").alias("_n"))
        one = objects.groupBy(*by).agg(F.avg("_m").alias("difference"), F.count("*").alias("objects"), F.sum("_n").alias("samples"), F.count_if(F.col("_m") > 0).alias("positive"), F.count_if(F.col("_m") < 0).alias("negative"))
        one = one.withColumn("contrast", F.lit(f"{left} - {right}"))
        out = one if out is None else out.unionByName(one)
    return out


def effects(a: DataFrame, b: DataFrame, keys: list[str], obj: str, value: str = "value") -> DataFrame:
    """Per object the mean change from condition b to condition a over samples that both define."""
    joined = a.select(*keys, obj, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    d = F.col("_a") - F.col("_b")
    return joined.groupBy(obj).agg(F.avg(d).alias("effect"), F.count(d).alias("defined"), F.count("*").alias("samples"))


def native_changes(df: DataFrame, by: list[str], obj: str, value: str) -> DataFrame:
    """Object-balanced mean, and median with 5 and 95 % quantiles of the raw values."""
    objects = df.groupBy(*by, obj).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("_m").alias("objects"))
    return objects.join(quantiles(df, by, value, {"median": 0.5, "p5": 0.05, "p95": 0.95}), by)


def density_study(df: DataFrame, by: list[str], obj: str, repeat: str, value: str) -> DataFrame:
    """Repeats averaged within objects, then objects, with the mean spread between an object's repeats."""
    cells = df.groupBy(*by, obj, repeat).agg(F.avg(value).alias("_m"))
    objects = cells.groupBy(*by, obj).agg(F.avg("_m").alias("_m"), (F.max("_m") - F.min("_m")).alias("_s"))
    return objects.groupBy(*by).agg(F.avg("_m").alias("mean"), F.avg("_s").alias("spread"), F.count("_m").alias("objects"))


def strata(df: DataFrame, sets: DataFrame, key: str, stratum: str, by: list[str], obj: str, value: str) -> DataFrame:
    """Object-balanced means by metadata stratum; an observation counts in each stratum that lists it."""
    joined = df.join(sets.select(key, stratum).distinct(), key)
    objects = joined.groupBy(stratum, *by, obj).agg(F.avg(value).alias("_m"))
    return objects.groupBy(stratum, *by).agg(F.avg("_m").alias("mean"), F.count("_m").alias("objects"))
