"""Selections: ranks, quotas, spaced and stratified choices, point budgets. All choices depend on stable ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconlake.functions.expr import hash_rank
from reconlake.operators.quantiles import quantiles
from reconlake.plans.ordinals import numbered


def _w(by: list[str], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def first_rows(df: DataFrame, by: list[str], order: list, k) -> DataFrame:
    """The first k rows of each group. With a constant k Spark keeps k rows a task and group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(_w(by, *order))).where(F.col("_n") <= k).drop("_n")


def hash_topk(df: DataFrame, by: list[str], key: str, seed: str, k: int) -> DataFrame:
    """K rows of each group by hash of seed and key, with their rank from 1."""
    ranked = df.withColumn("rank", F.row_number().over(_w(by, hash_rank(seed, key), key)))
    return ranked.where(F.col("rank") <= k)


def spaced_select(df: DataFrame, obj: str = "object_id", scene: str = "scene_id", frame: str = "image_id", bin_col: str = "visibility_bin", rank: str = "rank", gap: int = 15, per_bin: int = 2, total: int = 6, bins: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """Per object a greedy choice in rank order: per_bin rows of each bin in turn, then any, up to total rows.

    A row is taken if it is at least `gap` frames from all taken rows of its scene. The choice is a fold over the object's rows.
    The few taken rows rule out at most total * (2 gap - 1) frames, so of an object only that many first rows, and as many
    of each bin, can matter: no more enter the fold, however many the object has. Of rows of one frame and bin the first counts.
    """
    best = df.groupBy(obj, scene, frame, bin_col).agg(F.min(F.col(rank).cast("string")).alias("_r"))
    need = total * 2 * gap * len(bins)
    some = first_rows(best, [obj], ["_r"], need).unionByName(first_rows(best, [obj, bin_col], ["_r"], need)).distinct()
    item = F.struct(F.col("_r").alias("r"), F.col(scene).cast("long").alias("s"), F.col(frame).cast("long").alias("f"), F.col(bin_col).cast("string").alias("b"))
    rows = some.groupBy(obj).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    none = F.filter("rows", lambda _: F.lit(False))

    def free(taken: Column, x: Column) -> Column:
        return F.forall(taken, lambda t: (t["s"] != x["s"]) | (F.abs(t["f"] - x["f"]) >= gap))

    def of_bin(taken: Column, b: str) -> Column:
        mine = F.filter("rows", lambda x: x["b"] == b)
        fits = lambda t, x: (F.size(F.filter(t, lambda y: y["b"] == b)) < per_bin) & free(t, x)
        return F.aggregate(mine, taken, lambda t, x: F.when(fits(t, x), F.concat(t, F.array(x))).otherwise(t))

    chosen = none
    for b in bins:
        chosen = of_bin(chosen, b)
    rows = rows.withColumn("_chosen", chosen)
    more = lambda t, x: F.when((F.size(t) < total) & free(t, x), F.concat(t, F.array(x))).otherwise(t)
    rows = rows.withColumn("_chosen", F.aggregate("rows", F.col("_chosen"), more))
    out = rows.select(obj, F.posexplode("_chosen").alias("_at", "_x"))
    return out.select(obj, (F.col("_at") + 1).alias("pick"), F.col("_x.s").alias(scene), F.col("_x.f").alias(frame), F.col("_x.b").alias(bin_col), F.col("_x.r").alias(rank))


def relative_thirds(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of the bottom and top third (rounded up) of each group, labelled relative-low / relative-high; a row may be both."""
    w = _w(by, *order)
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", n).withColumn("_t", F.ceil(F.col("_n") / 3))
    label = F.array_compact(F.array(F.when(F.col("_i") <= F.col("_t"), F.lit("relative-low")), F.when(F.col("_i") > F.col("_n") - F.col("_t"), F.lit("relative-high"))))
    return rows.withColumn("stratum", F.explode(label)).drop("_i", "_n", "_t")


def pair_select(df: DataFrame, by: str, scene: str, frame: str, rank: str, stratum: str = "stratum", gate: Column | None = None) -> DataFrame:
    """Per object the first passing low row, then the first passing high row of another scene, or else of another frame."""
    rows = df.where(gate) if gate is not None else df
    low = first_rows(rows.where(F.col(stratum) == "relative-low"), [by], [rank], 1)
    other = low.select(F.col(by).alias("_o"), F.col(scene).alias("_s"), F.col(frame).alias("_f"))
    high = rows.where(F.col(stratum) == "relative-high").join(other, F.col(by) == F.col("_o"))
    high = high.where((F.col(scene) != F.col("_s")) | (F.col(frame) != F.col("_f")))
    high = first_rows(high, [by], [(F.col(scene) == F.col("_s")).cast("int"), rank], 1).drop("_o", "_s", "_f")
    return low.unionByName(high)


def top_views(df: DataFrame, by: list[str], pixels: str, key: str, n: int) -> DataFrame:
    """The n rows of each asset with most visible pixels, ties by id."""
    return first_rows(df, by, [F.col(pixels).desc(), key], n)


def lightest_unique(df: DataFrame, split: str, digest: str, weight: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """Per split, in the order given, the lightest rows whose digest no earlier split has selected, one row a digest."""
    out, taken = None, None
    for name, k in quotas.items():
        rows = df.where(F.col(split) == name)
        if taken is not None:
            rows = rows.join(taken, digest, "left_anti")
        rows = first_rows(rows, [digest], [weight, key], 1)
        rows = rows.orderBy(weight, key).limit(k)
        out = rows if out is None else out.unionByName(rows)
        taken = out.select(digest).distinct()
    return out


def midpoint_strata(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """Rows at floor((i + 0.5) N / n) of each ordered group, or all rows where there are at most n."""
    rows = df.withColumn("_at", F.row_number().over(_w(by, *order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    # row k is chosen if some i has floor((i + 0.5) N / n) = k: the smallest i that reaches k doesn't pass it
    i = F.ceil(F.col("_at") * n / F.col("_n") - 0.5)
    hit = (F.floor((F.greatest(i, F.lit(0)) + 0.5) * F.col("_n") / n) == F.col("_at")) & (i < n)
    return rows.where((F.col("_n") <= n) | hit).drop("_at", "_n")


def apportion(strata: DataFrame, name: str, size: str, total: int, seed: str) -> DataFrame:
    """Quota of each stratum by largest remainders, ties by hash. One row a stratum, so one window over all of them."""
    everything = Window.partitionBy(F.lit(0))
    rows = strata.withColumn("_d", F.lit(total) * F.col(size) / F.sum(size).over(everything)).withColumn("_f", F.floor("_d"))
    left = F.lit(total) - F.sum("_f").over(everything)
    rank = F.row_number().over(everything.orderBy(F.round(F.col("_d") - F.col("_f"), 12).desc(), hash_rank(seed, name)))
    rows = rows.withColumn("_left", left).withColumn("_rank", rank)
    return rows.withColumn("quota", (F.col("_f") + (F.col("_rank") <= F.col("_left")).cast("long")).cast("long")).drop("_d", "_f", "_left", "_rank")


def priority(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """admission_priority from 0 within each pool, by hash."""
    return df.withColumn("admission_priority", F.row_number().over(_w(by, hash_rank(seed, key), key)) - 1)


def quota_topk(df: DataFrame, by: str, key: str, preferred: Column, quotas: DataFrame, seed: str, quota: str = "quota") -> DataFrame:
    """Per category its quota of rows, preferred ones first, then by hash."""
    rows = df.withColumn("_n", F.row_number().over(_w([by], preferred.cast("int").desc(), hash_rank(seed, key), key)))
    return rows.join(quotas.select(by, F.col(quota).alias("_q")), by).where(F.col("_n") <= F.col("_q")).drop("_n", "_q")


def representative(df: DataFrame, family: str, preferred: Column, key: str) -> DataFrame:
    """One row of each family, of the preferred source if it has one, with the smallest key."""
    return first_rows(df, [family], [preferred.cast("int").desc(), key], 1)


def accumulate_frames(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n frames of each target over ordered arrangements, with the running count."""
    return df.withColumn("frame_no", F.row_number().over(_w(by, *order))).where(F.col("frame_no") <= n)


def exposure_ordinal(df: DataFrame, run: str, asset: str, step: str) -> DataFrame:
    """How often the asset has been shown in the run, this step included."""
    return df.withColumn("exposure", F.row_number().over(_w([run, asset], step)))


def running_balance(df: DataFrame, run: str, category: str, step: str, checkpoints: list[int]) -> DataFrame:
    """Per run, checkpoint and category, the steps up to the checkpoint; categories unseen by then are absent."""
    points = F.explode(F.array_compact(F.array(*[F.when(F.col(step) <= c, F.lit(c)) for c in checkpoints])))
    return df.select(run, category, points.alias("checkpoint")).groupBy(run, "checkpoint", category).agg(F.count("*").alias("n"))


def quantile_slots(df: DataFrame, by: list[str], value: str, key: str, slots: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """For each slot the row of nearest relative rank (ties to smaller key); a row may fill several slots."""
    w = _w(by, value, key)
    rows = df.where(F.col(value).isNotNull()).withColumn("relative_rank", F.percent_rank().over(w))
    rows = rows.withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    return first_rows(rows, [*by, "slot"], [F.round(F.abs(F.col("relative_rank") - F.col("slot")), 12), key], 1)


def median_order(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """Rows by distance from their group's median, nearest first (rank from 1)."""
    mid = quantiles(df, by, value, {"median": 0.5})
    return df.join(mid, by).withColumn("rank", F.row_number().over(_w(by, F.round(F.abs(F.col(value) - F.col("median")), 12).asc_nulls_last(), key)))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each distinct value with the share of the group's values up to it. Counts come first, so windows hold distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = _w(by, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(*by)))


def canary(df: DataFrame, by: str, key: str, seed: str, groups: int, each: int = 1) -> DataFrame:
    """`groups` groups of smallest hash, and `each` rows of smallest hash in them."""
    chosen = df.select(by).distinct().orderBy(hash_rank(seed, by), by).limit(groups)
    return hash_topk(df.join(chosen, by, "left_semi"), [by], key, seed, each)


def first_eligible(df: DataFrame, obj: str, key: str, n: int) -> DataFrame:
    """The smallest id of each of the first n objects."""
    return df.groupBy(obj).agg(F.min(key).alias(key)).orderBy(obj).limit(n)


def global_ordinal(df: DataFrame, group: str, order: str, seed: str) -> DataFrame:
    """Ordinal over groups in order: a row's place by group, then order, over all groups; and a seed derived from it. Rows without a group are left out."""
    rows = numbered(df.where(F.col(group).isNotNull()), [group, order], "ordinal")
    return rows.withColumn("ordinal_hash", hash_rank(seed, "ordinal"))


def depth_quantum(px: DataFrame, by: list[str], depth: str, mask: str = "mask") -> DataFrame:
    """(by, quantum, steps): the depth step of each raster's sensor, and how many steps it rests on; no row where there is none.

    Steps are differences over 1e-7 of neighbouring distinct depths of masked pixels; the quantum is the median of those at most 1.5
    times their 10 % quantile. Steps are compared to 12 decimals, since differences of equal steps differ in their last bits.
    """
    values = px.where(F.col(mask) & (F.col(depth) > 0)).select(*by, depth).distinct()
    step = values.withColumn("_s", F.round(F.col(depth) - F.lag(depth).over(_w(by, depth)), 12)).where("_s > 1e-7")
    low = quantiles(step, by, "_s", {"_q": 0.1})
    lower = step.join(low, by).where(F.col("_s") <= F.round(1.5 * F.col("_q"), 12))
    return quantiles(lower, by, "_s", {"quantum": 0.5}).join(lower.groupBy(*by).agg(F.count("*").alias("steps")), by)


def stable_order(df: DataFrame, keys: list[str], seed: str, key: str) -> DataFrame:
    """Total order by keys, ties by hash."""
    return df.orderBy(*keys, hash_rank(seed, key), key)


def batch_slice(df: DataFrame, keys: list[str], start: int, n: int) -> DataFrame:
    """N rows of the order, after `start` rows."""
    return df.orderBy(*keys).offset(start).limit(n)


def point_budget(pts: DataFrame, by: list[str], point: str, n: int, purpose: str = "point-selection") -> DataFrame:
    """At most n points of each cloud, by hash of the cloud's and the point's id, so alike for every method that shares them."""
    return first_rows(pts, by, [hash_rank(purpose, *by, point), point], n)


def shared_cap(counts: DataFrame, by: list[str], n: str, least: int = 512, most: int = 16384) -> DataFrame:
    """Smallest count among clouds of at least `least` points, at most `most`; `least` where there are none."""
    return counts.groupBy(*by).agg(F.least(F.lit(most), F.coalesce(F.min(F.when(F.col(n) >= least, F.col(n))), F.lit(least))).cast("long").alias("cap"))
