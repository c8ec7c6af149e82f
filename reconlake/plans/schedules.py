"""Splits and paired training schedules. Permutations are orders by hash, so a plan is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconlake.functions.expr import hash_index, hash_rank, stable_seed
from reconlake.operators.select import apportion, priority
from reconlake.plans.ordinals import numbered


def split_families(df: DataFrame, total: int, seed: str, family: str = "family_id", key: str = "key", stratum: str = "stratum", pilot: str = "pilot") -> DataFrame:
    """Df with split_pool and admission_priority. Families with a pilot member train; of the others `total` rows are drawn by
    strata (largest remainders), and their families validate."""
    used = df.where(F.col(pilot)).select(family).distinct()
    free = df.join(used, family, "left_anti")
    quotas = apportion(free.groupBy(stratum).agg(F.count("*").alias("size")), stratum, "size", total, seed)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_rank(seed, key), key))
    drawn = free.withColumn("_n", rank).join(quotas.select(stratum, "quota"), stratum).where("_n <= quota").select(family).distinct().withColumn("_v", F.lit(True))
    rows = df.join(drawn, family, "left").withColumn("split_pool", F.when(F.col("_v"), "synthetic_validation").otherwise("train")).drop("_v")
    return priority(rows, ["split_pool"], key, seed)


def half_pools(df: DataFrame, category: str, key: str, base: Column, seed: str) -> DataFrame:
    """Pools base and mix of each category, both of half its size: base rows first by hash; mix takes a quarter of each kind.

    The size is twice the whole half of the smaller kind, so leftovers have no pool (null).
    """
    kind = df.withColumn("_base", base).withColumn("_n", F.row_number().over(Window.partitionBy(category, "_base").orderBy(hash_rank(seed, key), key)))
    sizes = df.withColumn("_base", base).groupBy(category).agg(F.least(F.count_if("_base"), F.count_if(~F.col("_base"))).alias("_least"))
    rows = kind.join(sizes, category).withColumn("_half", F.floor(F.col("_least") / 2))
    in_base = F.col("_base") & (F.col("_n") <= 2 * F.col("_half"))
    in_mix = F.col("_n") <= F.col("_half")
    return rows.withColumn("in_base", in_base).withColumn("in_mix", in_mix).drop("_base", "_n", "_least", "_half")


def exposure_schedule(ids: DataFrame, accepted: DataFrame, seed: int, epochs: int = 4, novel_views: int = 21, key: str = "sample_id", name: str = "classic") -> DataFrame:
    """Steps 1..n of one training run: every epoch shows each sample once in its own hash order.

    An augmentation is attempted if epoch + ordinal is odd and takes effect if the sample is accepted; two different
    views are drawn a step. Ordinals follow the samples' ids, steps the epochs and the order in them; both are numbered over ranges.
    """
    if epochs <= 0 or epochs % 2:
        raise ValueError("epochs must be even")
    rows = numbered(ids.select(key), [key], "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("seed", F.lit(seed))
    rows = numbered(rows.withColumn("_h", hash_rank(f"{name}/order", "seed", "epoch", key)), ["epoch", "_h", key], "step")
    rows = rows.drop("_h").withColumn("step", F.col("step") + 1)
    first = hash_index(novel_views, f"{name}/view", "seed", "step")
    other = hash_index(novel_views - 1, f"{name}/other", "seed", "step")
    rows = rows.withColumn("_a", first).withColumn("_b", other).withColumn("views", F.array(F.col("_a"), F.col("_b") + (F.col("_b") >= F.col("_a")).cast("int")))
    yes = accepted.select(key).distinct().withColumn("_yes", F.lit(True))
    rows = rows.join(yes, key, "left").withColumn("augmentation_attempt", (F.col("epoch") + F.col("ordinal")) % 2 == 1)
    rows = rows.withColumn("effective_augmentation", F.col("augmentation_attempt") & F.coalesce("_yes", F.lit(False)))
    rows = rows.withColumn("augmentation_seed", stable_seed(name, F.concat_ws("/", "seed", "step")))
    return rows.select("seed", "step", "epoch", "ordinal", key, "views", "augmentation_attempt", "effective_augmentation", "augmentation_seed")


def balanced_schedule(pools: DataFrame, spark: SparkSession, seed: int, cycles: int, category: str = "category", key: str = "asset", name: str = "balanced") -> DataFrame:
    """Steps in cycles that show each category once in hash order; a category's assets come in rounds, each reshuffled."""
    cats = pools.groupBy(category).agg(F.count("*").alias("size"))
    rows = cats.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    place = F.row_number().over(Window.partitionBy("cycle").orderBy(hash_rank(f"{name}/{seed}/cycle", "cycle", category), category))
    n = F.count("*").over(Window.partitionBy("cycle"))
    rows = rows.withColumn("step", F.col("cycle") * n + place).withColumn("round", F.floor(F.col("cycle") / F.col("size"))).withColumn("slot", F.col("cycle") % F.col("size"))
    rounds = rows.groupBy(category).agg(F.max("round").alias("_last"))
    assets = pools.join(rounds, category).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    slot = F.row_number().over(Window.partitionBy(category, "round").orderBy(hash_rank(f"{name}/{seed}/round", category, "round", key), key)) - 1
    return rows.join(assets.withColumn("slot", slot.cast("long")).select(category, "round", "slot", key), [category, "round", "slot"]).select(F.lit(seed).alias("seed"), "step", "cycle", category, key)


def check_schedule(schedule: DataFrame, key: str, step: str = "step") -> DataFrame:
    """One row: steps, samples, fewest and most exposures of a sample, and whether steps are 1..n once each."""
    n = schedule.groupBy(key).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("least"), F.max("_n").alias("most"), F.count("*").alias("samples"), F.lit(0).alias("_k"))
    s = schedule.agg(F.count("*").alias("steps"), ((F.count_distinct(step) == F.count("*")) & (F.min(step) == 1) & (F.max(step) == F.count("*"))).alias("steps_complete"), F.lit(0).alias("_k"))
    return n.join(s, "_k").drop("_k")


def matched_prefix(a: DataFrame, b: DataFrame, cols: list[str], step: str = "step") -> DataFrame:
    """Steps of the shorter schedule at which the two differ in a column."""
    y = b.select(F.col(step).alias("_s"), *[F.col(c).alias(f"_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(y, F.col(step) == F.col("_s")).where(~same).select(step, *cols)


def training_plans(rows: DataFrame, seeds: list[int], arms: list[str], epochs: int = 4, key: str = "sample_id", accepted: str = "accepted") -> DataFrame:
    """Schedules of every seed and arm. Arms of a seed share steps, views and attempts; the arm "base" never augments."""
    out = None
    for s in seeds:
        one = exposure_schedule(rows, rows.where(F.col(accepted)), s, epochs, key=key)
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    for c in ("augmentation_attempt", "effective_augmentation"):
        out = out.withColumn(c, F.col(c) & (F.col("arm") != "base"))
    return out


def audit_buckets(df: DataFrame, bucket: str, key: str, geometry: str, seed: str, dev: int = 3, sentinel: int = 1) -> DataFrame:
    """Per bucket dev and sentinel assets by hash, one asset a geometry over all buckets, the earliest bucket first."""
    unique = df.withColumn("_n", F.row_number().over(Window.partitionBy(geometry).orderBy(bucket, hash_rank(seed, key), key))).where("_n = 1").drop("_n")
    rows = unique.withColumn("_n", F.row_number().over(Window.partitionBy(bucket).orderBy(hash_rank(seed, key), key))).where(F.col("_n") <= dev + sentinel)
    return rows.withColumn("role", F.when(F.col("_n") <= dev, "dev").otherwise("sentinel")).drop("_n")


def bucket_shortage(df: DataFrame, chosen: DataFrame, bucket: str, dev: int = 3, sentinel: int = 1) -> DataFrame:
    """By bucket of df, how many dev and sentinel assets are missing."""
    have = chosen.groupBy(bucket).agg(F.count_if(F.col("role") == "dev").alias("_d"), F.count_if(F.col("role") == "sentinel").alias("_s"))
    every = df.groupBy(bucket).agg(F.count("*").alias("eligible"))
    return every.join(have, bucket, "left").select(bucket, "eligible", (dev - F.coalesce("_d", F.lit(0))).alias("short_dev"), (sentinel - F.coalesce("_s", F.lit(0))).alias("short_sentinel"))
