"""Aggregations: counters, object-balanced means, exact quantiles, cubes. Undefined metrics are null and never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.operators.quantiles import quantiles as exact_quantiles
from reconlake.operators.quantiles import with_quantiles


def status_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each status."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def counter_summary(df: DataFrame, counters: dict[str, Column], expected: dict[str, int] | None = None) -> DataFrame:
    """One row of conditional counts; with expected counts, matches tells whether all are met."""
    out = df.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])
    if expected:
        same = F.lit(True)
        for k, n in expected.items():
            same &= F.col(k) == n
        out = out.withColumn("matches", same)
    return out


def object_mean(df: DataFrame, by: list[str], obj: str, value: str) -> DataFrame:
    """Mean over objects of the mean over their defined views, with defined and total views and objects.

    An object without a defined view doesn't count in the mean; a group without any has a null mean.
    """
    views = df.groupBy(*by, obj).agg(F.avg(value).alias("_m"), F.count(value).alias("_d"), F.count("*").alias("_n"))
    return views.groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("_m").alias("objects_defined"), F.count("*").alias("objects"), F.sum("_d").alias("views_defined"), F.sum("_n").alias("views"))


def strict_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, null if any member is null."""
    return df.groupBy(*by).agg(F.when(F.count("*") == F.count(value), F.avg(value)).alias("mean"), F.count("*").alias("n"))


def seed_mean(df: DataFrame, by: list[str], sample: str, obj: str, value: str) -> DataFrame:
    """Seeds are averaged in each sample, samples in each object, then objects."""
    samples = df.groupBy(*by, obj, sample).agg(F.avg(value).alias(value))
    return object_mean(samples, by, obj, value)


def category_macro(df: DataFrame, by: list[str], category: str, value: str) -> DataFrame:
    """Mean of category means of paired differences."""
    inner = df.groupBy(*by, category).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*by).agg(F.avg("_m").alias("macro_mean"), F.count("_m").alias("categories"))


def sign_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Positive, negative and zero values; nulls count nowhere."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count_if(v == 0).alias("ties"))


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], approximate: bool = False) -> DataFrame:
    """Exact interpolated quantiles, one column a name; approximate sketches only on request."""
    if approximate:
        return df.groupBy(*by).agg(*[F.approx_percentile(value, F.lit(q), F.lit(10000)).alias(k) for k, q in qs.items()])
    return exact_quantiles(df, by, value, qs)


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation."""
    mid = exact_quantiles(df, by, value, {"median": 0.5})
    rows = df.join(mid, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return exact_quantiles(rows, [*by, "median"], "_d", {"mad": 0.5})


def extents(pts: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """A10: size and centre along each axis, and the diagonal."""
    box = pts.groupBy(*by).agg(*[f(a).alias(f"_{k}{a}") for a in axes for k, f in (("lo", F.min), ("hi", F.max))])
    size = {a: F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in axes}
    total = sum((s * s for s in list(size.values())[1:]), size[axes[0]] * size[axes[0]])
    return box.select(*by, *[s.alias(f"size_{a}") for a, s in size.items()], *[((F.col(f"_hi{a}") + F.col(f"_lo{a}")) / 2).alias(f"centre_{a}") for a in axes], F.sqrt(total).alias("diagonal"))


def summary_cube(df: DataFrame, populations: dict[str, Column], by: list[str], obj: str, value: str) -> DataFrame:
    """Object-balanced means of overlapping populations: a row counts in each population whose condition holds."""
    member = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in populations.items()])))
    return object_mean(df.withColumn("population", member), ["population", *by], obj, value)


def margins(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts and means for every combination of the keys and for all of them together (nulls stand for all)."""
    return df.cube(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.grouping_id().alias("level"))


def weighted_ratio(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Sum of weight times value over sum of weights, rows with a null value left out."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("ratio"))


def leave_one_out(df: DataFrame, by: list[str], scene: str, obj: str, value: str) -> DataFrame:
    """Object-balanced mean without each scene in turn, from sums that are taken off the totals; objects that vanish don't count."""
    every = by
    if not by:
        df, by = df.withColumn("_one", F.lit(0)), ["_one"]
    cell = df.groupBy(*by, scene, obj).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = cell.groupBy(*by, obj).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    base = total.where("_tn > 0").groupBy(*by).agg(F.sum(F.col("_ts") / F.col("_tn")).alias("_all"), F.count("*").alias("_objects"))
    both = cell.join(total, [*by, obj]).where("_tn > 0")
    rest = F.when(F.col("_tn") > F.col("_n"), (F.col("_ts") - F.coalesce("_s", F.lit(0.0))) / (F.col("_tn") - F.col("_n")))
    change = both.groupBy(*by, scene).agg(F.sum(F.coalesce(rest, F.lit(0.0)) - F.col("_ts") / F.col("_tn")).alias("_change"), F.count_if(rest.isNull()).alias("_gone"))
    out = change.join(base, by)
    kept = F.col("_objects") - F.col("_gone")
    return out.select(*every, scene, F.when(kept > 0, (F.col("_all") + F.col("_change")) / kept).alias("mean"), kept.alias("objects"))


def family_rollup(df: DataFrame, family: str, key: str) -> DataFrame:
    """Sorted members of each family, and the family's id: the hash of their joined names. Families hold few members each."""
    out = df.groupBy(family).agg(F.array_sort(F.collect_set(key)).alias("members"))
    return out.select(family, F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("n_members"), F.sha2(F.array_join("members", "\n"), 256).alias("family_id"))


def exposure_totals(df: DataFrame, by: list[str], attempt: str, effective: str, changed: str) -> DataFrame:
    """Exposures, attempts, effective augmentations and the mean changed share among effective ones."""
    return df.groupBy(*by).agg(F.count("*").alias("exposures"), F.count_if(F.col(attempt)).alias("attempts"), F.count_if(F.col(effective)).alias("effective"), F.avg(F.when(F.col(effective), F.col(changed))).alias("mean_changed"))


def subset_coverage(df: DataFrame, subset: str, model: str, sample: str, obj: str) -> DataFrame:
    """Distinct samples and objects of each subset by model, and whether all models have the same."""
    per = df.groupBy(subset, model).agg(F.count_distinct(sample).alias("_s"), F.count_distinct(obj).alias("_o"))
    return per.groupBy(subset).agg(F.min("_s").alias("samples"), F.min("_o").alias("objects"), ((F.min("_s") == F.max("_s")) & (F.min("_o") == F.max("_o"))).alias("equal"))


def distance_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Range, mean and coverage of a metric that is defined for some rows."""
    return df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count(value).alias("defined"), F.count("*").alias("n"))


def accept_histogram(df: DataFrame, key: str, accepted: Column) -> DataFrame:
    """How many geometries have how many accepted edits."""
    return df.groupBy(key).agg(F.count_if(accepted).alias("accepted")).groupBy("accepted").agg(F.count("*").alias("geometries"))


def run_telemetry(log: DataFrame, by: list[str], seconds: str, memory: str) -> DataFrame:
    """Median step seconds, total hours and peak bytes."""
    sums = log.groupBy(*by).agg((F.sum(seconds) / 3600).alias("hours"), F.max(memory).alias("peak"))
    return with_quantiles(sums, log, by, seconds, {"median_s": 0.5}).select(*by, "median_s", "hours", "peak")


def duplicate_excess(df: DataFrame, *digest: str) -> DataFrame:
    """Groups of equal digests, and rows beyond the first of each."""
    n = df.groupBy(*digest).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def median_across(df: DataFrame, by: list[str], sample: str, value: str) -> DataFrame:
    """Median over samples of each sample's median."""
    one = exact_quantiles(df, [*by, sample], value, {"_m": 0.5})
    return with_quantiles(one.groupBy(*by).agg(F.count("*").alias("samples")), one, by, "_m", {"median": 0.5}).select(*by, "median", "samples")


def best_step(curves: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """The first step with the smallest value; undefined values don't count."""
    best = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(step).alias("s"))))
    return curves.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.s").alias("step"), F.col("_b.v").alias("value"))


def distinct_counts(df: DataFrame, by: list[str], cols: dict[str, str], approximate: bool = False) -> DataFrame:
    """Distinct values of several columns; sketches only on request."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(*[f(c).alias(k) for k, c in cols.items()])
