"""Surface scores: visibility against depth rasters, precision and recall at distances, Chamfer, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions.expr import fscore, pixel_of, project
from reconlake.operators.neighbours import nn_join, within
from reconlake.operators.quantiles import quantiles, with_quantiles
from reconlake.operators.spatial import patch_join
from reconlake.plans.lineage import stored

THRESHOLDS = (0.002, 0.005, 0.010)


def _pixels(pts: DataFrame, cams: DataFrame, sample: str, inset: float = 1.0) -> DataFrame:
    """pts with zc (depth along the view) and the pixel v, u where it lies inside the frame by `inset` pixels; else null."""
    rows = pts.join(cams, sample)
    u, v = project("x", "y", "z", "fx", "fy", "cx", "cy")
    rows = rows.withColumn("zc", -F.col("z")).withColumn("_pu", u).withColumn("_pv", v)
    ok = (F.col("_pu") >= inset - 0.5) & (F.col("_pu") < F.col("width") - 0.5 - inset) & (F.col("_pv") >= inset - 0.5) & (F.col("_pv") < F.col("height") - 0.5 - inset)
    return rows.withColumn("v", F.when(ok, pixel_of("_pv"))).withColumn("u", F.when(ok, pixel_of("_pu"))).drop("_pu", "_pv")


def visibility(pts: DataFrame, px: DataFrame, cams: DataFrame, tolerance: float = 0.005, span: float = 0.010, sample: str = "sample_id", point: str = "point_id") -> DataFrame:
    """Pts with visible, occluded, uncertain, known_free and supported.

    A point is supported if all nine depths around its pixel lie in (0.1, 10] and within `span`; it is then compared with
    their median. Unsupported points are uncertain; so are points in front of the surface (known_free).
    """
    rows = _pixels(pts, cams, sample)
    good = (F.col("_v") > 0.1) & (F.col("_v") <= 10) & ~F.isnan("_v")
    patch = patch_join(rows.where("v is not null"), px, sample, point).groupBy(sample, point).agg(
        ((F.count_if(good) == 9) & (F.max("_v") - F.min("_v") <= span)).alias("_ok"), F.percentile("_v", F.lit(0.5)).alias("_ref")
    )
    out = rows.join(patch, [sample, point], "left").withColumn("supported", F.coalesce("_ok", F.lit(False)))
    d = F.col("zc") - F.col("_ref")
    out = out.withColumn("visible", F.col("supported") & (F.abs(d) <= tolerance)).withColumn("occluded", F.col("supported") & (d > tolerance)).withColumn("known_free", F.col("supported") & (d < -tolerance))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("visible", "occluded", "known_free", "supported")]
    out = out.select(*pts.columns, *flags)
    return out.withColumn("uncertain", ~(F.col("visible") | F.col("occluded")))


def _masked(pts: DataFrame, px: DataFrame, cams: DataFrame, sample: str, point: str) -> DataFrame:
    """pts with lo and hi, the least and greatest depth of masked pixels with depth around each point's pixel; null if there is none."""
    rows = _pixels(pts, cams, sample, 0.0)
    good = px.where(F.col("mask") & (F.col("depth") > 0) & ~F.isnan("depth"))
    patch = patch_join(rows.where("v is not null"), good, sample, point).groupBy(sample, point).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    return rows.join(patch, [sample, point], "left")


def visibility_min(pts: DataFrame, px: DataFrame, cams: DataFrame, tolerance: float = 0.005, sample: str = "sample_id", point: str = "point_id") -> DataFrame:
    """Visible, occluded, known_free and uncertain against the nearest masked depth around each point."""
    rows = _masked(pts, px, cams, sample, point)
    d = F.col("zc") - F.col("lo")
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = rows.select(*pts.columns, flag(F.abs(d) <= tolerance).alias("visible"), flag(d > tolerance).alias("occluded"), flag(d < -tolerance).alias("known_free"))
    return out.withColumn("uncertain", ~(F.col("visible") | F.col("occluded")))


def visibility_max(pts: DataFrame, px: DataFrame, cams: DataFrame, margin: float = 0.005, sample: str = "sample_id", point: str = "point_id") -> DataFrame:
    """Label 0 unknown (no masked depth around), 2 hidden (strictly deeper than the farthest plus margin), 1 supported; with the support's range."""
    rows = _masked(pts, px, cams, sample, point)
    label = F.when(F.col("hi").isNull(), 0).when(F.col("zc") > F.col("hi") + margin, 2).otherwise(1).cast("byte")
    return rows.select(*pts.columns, label.alias("label"), F.col("lo").alias("support_min"), F.col("hi").alias("support_max"))


def query_flags(q: DataFrame, px: DataFrame, cams: DataFrame, near: float = 0.005, margin: float = 0.005, sample: str = "sample_id", point: str = "point_id") -> DataFrame:
    """Q with certain_free (in front of all support by margin) and hidden_surface (near the surface, and deeper than the
    support or without any)."""
    rows = visibility_max(q, px, cams, margin, sample, point)
    z = -F.col("z")
    free = F.coalesce(z < F.col("support_min") - margin, F.lit(False))
    hidden = (F.col("udf_m") <= near) & (F.col("support_max").isNull() | (z > F.col("support_max") + margin))
    return rows.select(*q.columns, free.alias("certain_free"), F.coalesce(hidden, F.lit(False)).alias("hidden_surface"))


def distances(pred: DataFrame, truth: DataFrame, by: list[str], point: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Distances of predicted points to the truth and of true points to the prediction."""
    t = truth.withColumnRenamed(point, "other_id")
    forward = nn_join(pred, t, by, point, "other_id").select(*by, point, "distance")
    p = pred.withColumnRenamed(point, "other_id")
    return forward, nn_join(truth, p, by, point, "other_id").select(*by, point, "distance")


def score_distances(forward: DataFrame, backward: DataFrame, by: list[str], thresholds: tuple[float, ...] = THRESHOLDS, cap: float = 0.1) -> DataFrame:
    """Precision, recall and F at each threshold, Chamfer and capped Chamfer of each cloud with a truth.

    Without predicted points precision, recall and F are 0, Chamfer is null and capped Chamfer is the cap.
    """
    name = lambda t: f"{round(t * 1000):d}"
    side = lambda df, k: df.groupBy(*by).agg(F.avg("distance").alias(f"{k}_mean"), F.avg(F.least("distance", F.lit(cap))).alias(f"{k}_cap"), F.count("*").alias(f"{k}_n"), *[F.avg((F.col("distance") <= t).cast("double")).alias(f"{k}{name(t)}") for t in thresholds])
    rows = side(backward, "r").join(side(forward, "p"), by, "left")
    empty = F.col("p_n").isNull()
    cols = []
    for t in thresholds:
        p, r = F.coalesce(f"p{name(t)}", F.lit(0.0)), F.when(empty, 0.0).otherwise(F.col(f"r{name(t)}"))
        cols += [p.alias(f"precision{name(t)}"), r.alias(f"recall{name(t)}"), fscore(p, r).alias(f"fscore{name(t)}")]
    chamfer = F.when(~empty, (F.col("p_mean") + F.col("r_mean")) / 2)
    capped = F.when(empty, F.lit(cap)).otherwise((F.col("p_cap") + F.col("r_cap")) / 2)
    return rows.select(*by, *cols, chamfer.alias("chamfer"), capped.alias("chamfer_capped"), F.coalesce("p_n", F.lit(0)).alias("points"), F.col("r_n").alias("truth_points"))


def score_clouds(pred: DataFrame, truth: DataFrame, by: list[str], point: str = "point_id", thresholds: tuple[float, ...] = THRESHOLDS, cap: float = 0.1) -> DataFrame:
    """G13 from the clouds themselves."""
    return score_distances(*distances(pred, truth, by, point), by, thresholds, cap)


def surface_p95(forward: DataFrame, backward: DataFrame, by: list[str]) -> DataFrame:
    """95 % quantiles of accuracy and completeness distances and of both together."""
    f, b = forward.select(*by, "distance", F.lit(True).alias("f")), backward.select(*by, "distance", F.lit(False).alias("f"))
    both = f.unionByName(b)
    part = lambda test, name: quantiles(both.withColumn("_d", F.when(test, F.col("distance"))), by, "_d", {name: 0.95})
    return part(F.col("f"), "accuracy_p95").join(part(~F.col("f"), "completeness_p95"), by).join(part(F.lit(True), "chamfer_p95"), by)


def subset_recall(backward: DataFrame, flags: DataFrame, by: list[str], subsets: list[str], point: str = "point_id", t: float = 0.005) -> DataFrame:
    """Recall of each subset of true points, and its size; null for an empty subset, 0 without prediction."""
    hit = F.coalesce((F.col("distance") <= t).cast("double"), F.lit(0.0))
    rows = flags.join(backward, [*by, point], "left")
    return rows.groupBy(*by).agg(*[x for s in subsets for x in (F.avg(F.when(F.col(s), hit)).alias(f"recall_{s}"), F.count_if(s).alias(f"count_{s}"))])


def added_points(pred: DataFrame, dense: DataFrame, forward: DataFrame, by: list[str], point: str = "point_id", t: float = 0.005) -> DataFrame:
    """Predicted points without an input point within t, and the share of them that is near the truth (null if none)."""
    old = within(pred, dense, by, t).select(*by, point)
    rows = pred.select(*by, point).join(forward, [*by, point]).join(old.withColumn("_old", F.lit(True)), [*by, point], "left")
    new = F.col("_old").isNull()
    return rows.groupBy(*by).agg(F.count_if(new).alias("added"), F.avg(F.when(new, (F.col("distance") <= t).cast("double"))).alias("added_precision"))


def free_violations(flags: DataFrame, by: list[str]) -> DataFrame:
    """Share of predicted points in known free space, of all and of supported ones (null if there are none)."""
    free = F.col("known_free").cast("double")
    return flags.groupBy(*by).agg(F.avg(free).alias("rate_all"), F.avg(F.when(F.col("supported"), free)).alias("rate_supported"), F.count_if("known_free").alias("violations"))


def compare_clouds(a: DataFrame, b: DataFrame, by: list[str], point: str = "point_id") -> DataFrame:
    """Mean, 95 % quantile and maximum of nearest distances both ways, and whether the clouds are equal point by point."""
    f, g = distances(a, b, by, point)
    both = stored(f.unionByName(g), "distances")  # read by the mean and by the quantiles
    d = with_quantiles(both.groupBy(*by).agg(F.avg("distance").alias("mean"), F.max("distance").alias("max")), both, by, "distance", {"p95": 0.95}).select(*by, "mean", "p95", "max")
    x = a.select(*by, point, *[F.col(c).alias(f"_a{c}") for c in "xyz"], F.lit(1).alias("_l"))
    y = b.select(*by, point, *[F.col(c).alias(f"_b{c}") for c in "xyz"], F.lit(1).alias("_r"))
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in "xyz":
        same &= F.col(f"_a{c}").eqNullSafe(F.col(f"_b{c}"))
    return d.join(x.join(y, [*by, point], "full_outer").groupBy(*by).agg(F.bool_and(same).alias("identical")), by)


def reflect_cloud(pts: DataFrame, by: list[str], axis: str, point: str = "point_id") -> DataFrame:
    """the cloud and its mirror image about the centre of its box along an axis; mirrored points carry negative ids."""
    box = pts.groupBy(*by).agg((F.min(axis) + F.max(axis)).alias("_s"))
    other = pts.join(box, by).withColumn(axis, F.col("_s") - F.col(axis)).withColumn(point, -F.col(point) - 1).drop("_s")
    return pts.unionByName(other.select(*pts.columns))


def model_roi(pts: DataFrame, by: list[str], padding: float = 0.1, least: float = 0.05) -> DataFrame:
    """centre and half extent of a cube around each cloud, grown by a share and at least as large as given."""
    axes = ("x", "y", "z")
    box = pts.groupBy(*by).agg(*[f(a).alias(f"_{k}{a}") for a in axes for k, f in (("lo", F.min), ("hi", F.max))])
    half = F.greatest(*[(F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2 for a in axes]) * (1 + padding)
    return box.select(*by, *[((F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2).alias(f"centre_{a}") for a in axes], F.greatest(half, F.lit(least)).alias("half_extent"))


def roi_coordinates(pts: DataFrame, roi: DataFrame, by: list[str]) -> DataFrame:
    """points in units of their cube's half extent, from its centre."""
    rows = pts.join(roi, by)
    return rows.select(*by, *[c for c in pts.columns if c not in (*by, "x", "y", "z")], *[((F.col(a) - F.col(f"centre_{a}")) / F.col("half_extent")).alias(a) for a in "xyz"])


def inside_unit(*axes: str) -> Column:
    """Whether ROI coordinates lie in the cube."""
    return F.greatest(*[F.abs(F.col(a)) for a in axes or ("x", "y", "z")]) <= 1
