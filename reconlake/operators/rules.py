"""Filters, predicates and admission rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(df: DataFrame, pixels: str, visible: str, min_px: int = 512, min_vis: float = 0.1) -> DataFrame:
    """Rows with enough visible pixels and a large enough visible share."""
    return df.where((F.col(pixels) >= min_px) & (F.col(visible) >= min_vis))


def visibility_bin(col: str, low: float = 0.4, high: float = 0.7) -> Column:
    """Low, medium or high; null for null."""
    c = F.col(col)
    return F.when(c < low, "low").when(c < high, "medium").when(c.isNotNull(), "high")


def first_reason(rules: dict[str, Column]) -> Column:
    """The first rule (name: condition of rejection) that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in rules.items()], F.lit(None).cast("string"))


def reject_first(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Survivors of ordered rules, and how many rows each rule was the first to reject."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def reject_all(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Df with all reasons that hold."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))


def reason_histogram(rejected: DataFrame) -> DataFrame:
    """Rows by reason; a row counts under each of its reasons."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def catalog_candidates(df: DataFrame, categories: str, category: str, license_col: str, licenses: list[str], excluded: DataFrame, key: str) -> DataFrame:
    """Rows of exactly this one category and an allowed licence that aren't excluded."""
    rows = df.where((F.size(categories) == 1) & (F.get(F.col(categories), F.lit(0)) == category) & F.col(license_col).isin(licenses))
    return rows.join(excluded.select(key), key, "left_anti")


def exclude_families(df: DataFrame, family: str, reserved: Column) -> DataFrame:
    """Rows of families without a reserved member. Families are found first, so a large one isn't gathered."""
    held = df.where(reserved).select(family).distinct()
    return df.join(held, family, "left_anti")


def physics_gate(df: DataFrame, key: str, passed: str, orientations: int = 2) -> DataFrame:
    """Per key whether every one of the expected orientations passed."""
    ok = F.bool_and(F.coalesce(F.col(passed), F.lit(False))) & (F.count("*") == orientations)
    return df.groupBy(key).agg(ok.alias("passed"), F.count("*").alias("trials"))


def admit_quota(df: DataFrame, split: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """Df with decision admitted (first rows of each split up to its quota) or reserve; splits without quota are reserve."""
    quota = F.coalesce(*[F.when(F.col(split) == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy(split).orderBy(*order))
    return df.withColumn("decision", F.when(rank <= quota, "admitted").otherwise("reserve"))


def shortfall(admitted: DataFrame, split: str, quotas: dict[str, int]) -> DataFrame:
    """By split with a quota, how many rows it is short of."""
    want = admitted.sparkSession.createDataFrame(list(quotas.items()), f"{split} string, quota long")
    have = admitted.where("decision = 'admitted'").groupBy(split).agg(F.count("*").alias("n"))
    return want.join(have, split, "left").select(split, "quota", F.coalesce("n", F.lit(0)).alias("admitted"), (F.col("quota") - F.coalesce("n", F.lit(0))).alias("short"))


def registration_status(median: str, p95: str, max_median: float = 0.002, max_p95: float = 0.015) -> Column:
    """Passed, registration_flag, or input_failure where a quantile is undefined."""
    m, p = F.col(median), F.col(p95)
    undefined = m.isNull() | p.isNull() | F.isnan(m) | F.isnan(p)
    return F.when(undefined, "input_failure").when((m <= max_median) & (p <= max_p95), "passed").otherwise("registration_flag")


def check_prediction_status(df: DataFrame, key: str, status: str, n: str) -> DataFrame:
    """P10: keys whose status is unknown or contradicts the number of points: success has some, empty has none, failure has null."""
    s, c = F.col(status), F.col(n)
    good = ((s == "success") & (c > 0)) | ((s == "empty") & (c == 0)) | ((s == "failure") & c.isNull())
    return df.where(~F.coalesce(good, F.lit(False))).select(key, status, n)


def rgb_qa(px: DataFrame, sample: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Per frame the maximum, population deviation and share of values above 3; good: maximum above 3, deviation above 1."""
    values = px.select(sample, F.explode(F.array(*channels)).alias("_v"))
    out = values.groupBy(sample).agg(F.max("_v").alias("max"), F.stddev_pop("_v").alias("std"), F.avg((F.col("_v") > 3).cast("double")).alias("share_above_3"))
    return out.withColumn("good", (F.col("max") > 3) & (F.col("std") > 1))


def validate_scenes(df: DataFrame, key: str, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(key, severity, path, message) for each check (severity, path, message, condition that must hold) that fails; null fails."""
    issues = [F.when(~F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(p).alias("path"), F.lit(m).alias("message"))) for s, p, m, c in checks]
    return df.select(key, F.explode(F.array_compact(F.array(*issues))).alias("_i")).select(key, "_i.*")


def scene_checks(min_visible: float = 0.1, min_pixels: int = 200, max_fill: float = 0.6) -> list[tuple[str, str, str, Column]]:
    """Checks of instance metrics: visible_fraction, pixels, fill (share of the frame), border, frames, objects."""
    return [
        ("error", "instances", "too little of the object is visible", F.col("visible_fraction") >= min_visible),
        ("error", "instances", "too few pixels", F.col("pixels") >= min_pixels),
        ("warning", "instances", "the object fills the frame", F.col("fill") <= max_fill),
        ("warning", "instances", "the object touches the border", F.col("border") == 0),
        ("error", "scene", "no frames", F.col("frames") > 0),
        ("error", "scene", "no objects", F.col("objects") > 0),
    ]


def mask_qc(stats: DataFrame, sample: str, height: int, width: int, min_share: float = 0.01, max_share: float = 0.9, max_parts: int = 3) -> DataFrame:
    """Warnings on a mask's statistics: area, border contact, parts, and a mask in the lowest tenth of the frame only."""
    share = F.col("area") / (height * width)
    rules = {"small": share < min_share, "large": share > max_share, "border": F.col("border") > 0, "fragments": F.col("parts") > max_parts, "bottom band": F.col("v_min") >= 0.9 * height}
    return reject_all(stats, rules).select(sample, F.array_join("reasons", ",").alias("warnings"))


def admission(pairs: DataFrame, reviews: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pairs with accepted, admission_reason and review_status. Screens come first; an unreviewed pair that passes is accepted."""
    r = reviews.select(key, F.col("decision").alias("_d"))
    passed = F.coalesce(F.col("calibrated_silhouette_pass"), F.lit(False))
    # fixed values: reasons as they appear in results
    reason = F.when(~passed, "source_or_edit_SAM_screen_failed").when(F.col("_d").isNull(), "author_authorized_unreviewed_SAM_eligible").otherwise(F.concat(F.lit("visual_"), "_d"))
    out = pairs.join(r, key, "left").withColumn("admission_reason", reason)
    out = out.withColumn("accepted", passed & (F.col("_d").isNull() | (F.col("_d") == "pass")))
    return out.withColumn("review_status", F.coalesce("_d", F.lit("unreviewed"))).drop("_d")


def check_admission(pairs: DataFrame, reviews: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, problem): screens that contradict each other, and reviews of another decision than pass, reject or uncertain."""
    bad = pairs.where(~F.coalesce(F.col("calibrated_silhouette_pass") == (F.col("source_calibrated") & F.col("edited_raw_screen_pass")), F.lit(False)))
    odd = reviews.where(~F.coalesce(F.col("decision").isin("pass", "reject", "uncertain"), F.lit(False)))
    return bad.select(key, F.lit("screens contradict").alias("problem")).unionByName(odd.select(key, F.lit("unknown decision").alias("problem")))


def check_reviews(edits: DataFrame, reviews: DataFrame, px: DataFrame) -> DataFrame:
    """(sample_id, variant, problem) of reviewed edits against pixels (sample_id, variant, v, u, mask, source, edited).

    A missing review, an accepted edit that changes masked pixels or changes nothing, a fallback that isn't the source.
    """
    key = ["sample_id", "variant"]
    changed = ~F.col("source").eqNullSafe(F.col("edited"))
    seen = px.groupBy(*key).agg(F.count_if(changed & F.col("mask")).alias("in_mask"), F.count_if(changed).alias("changed"))
    rows = edits.select(*key).join(reviews.select(*key, "decision"), key, "left").join(seen, key, "left")
    accepted = F.col("decision") == "pass"
    rules = {
        "no review": F.col("decision").isNull(),
        "no pixels": F.col("changed").isNull(),
        "mask changed": accepted & (F.col("in_mask") > 0),
        "accepted edit equals source": accepted & (F.col("changed") == 0),
        "fallback differs from source": ~accepted & (F.col("changed") > 0),
    }
    return reject_all(rows, rules).select(*key, F.explode("reasons").alias("problem"))


def effective_source(df: DataFrame, accepted: str, edited: str, source: str) -> DataFrame:
    """Df with effective, the edit where it is accepted and else the source."""
    return df.withColumn("effective", F.when(F.col(accepted), F.col(edited)).otherwise(F.col(source)))


def paired_screen(rows: DataFrame, key: str = "sample_id", condition: str = "condition", passed: str = "passed") -> DataFrame:
    """Per sample the screens of source and edit, and whether both pass; a missing one doesn't."""
    of = lambda k: F.coalesce(F.bool_and(F.when(F.col(condition) == k, F.col(passed))), F.lit(False))
    out = rows.groupBy(key).agg(of("source").alias("source_calibrated"), of("edited").alias("edited_raw_screen_pass"))
    return out.withColumn("calibrated_silhouette_pass", F.col("source_calibrated") & F.col("edited_raw_screen_pass"))


def scene_guard(objects: DataFrame, scene: str, family: str, split: str, n: int) -> DataFrame:
    """Scenes that don't have n objects of n families in one split."""
    out = objects.groupBy(scene).agg(F.count("*").alias("objects"), F.count_distinct(family).alias("families"), F.count_distinct(split).alias("splits"))
    return out.where((F.col("objects") != n) | (F.col("families") != n) | (F.col("splits") != 1))


def frame_gate(frames: DataFrame, target: str, gates: dict[str, Column], n: int = 20) -> DataFrame:
    """Per target how many frames pass all gates, and whether it has n frames that all pass."""
    ok = F.lit(True)
    for c in gates.values():
        ok &= F.coalesce(c, F.lit(False))
    out = frames.withColumn("_ok", ok).groupBy(target).agg(F.count("*").alias("frames"), F.count_if("_ok").alias("passing"), F.bool_and("_ok").alias("_all"))
    return out.select(target, "frames", "passing", (F.col("_all") & (F.col("frames") == n)).alias("passed"))


def size_gate(assets: DataFrame, extent: str, faces: str, least: float = 0.02, most: float = 1.0, max_faces: int = 200_000) -> DataFrame:
    """P20: assets within a range of extents and up to a number of faces."""
    return assets.where(F.col(extent).between(least, most) & (F.col(faces) > 0) & (F.col(faces) <= max_faces))


def repair_list(scenes: DataFrame, excluded: list[str], scene: str, visible: str, removed: str) -> DataFrame:
    """Scenes with visible excluded assets, which to remove and keep, and whether the audit's list says the same."""
    ex = F.array(*[F.lit(x) for x in excluded])
    out = scenes.withColumn("_hit", F.array_sort(F.array_intersect(visible, ex))).where(F.size("_hit") > 0)
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(scene, text("_hit").alias("remove"), text(F.array_except(visible, ex)).alias("keep"), text("_hit").eqNullSafe(text(F.array_distinct(removed))).alias("audit_agrees"))


def reproduction_gate(metrics: DataFrame, iou: str = "iou", p95: str = "depth_p95", min_iou: float = 0.999, max_p95: float = 1e-5) -> DataFrame:
    """Whether a frame was reproduced: masks overlap and depths agree."""
    return metrics.withColumn("reproduced", F.coalesce((F.col(iou) >= min_iou) & (F.col(p95) <= max_p95), F.lit(False)))
