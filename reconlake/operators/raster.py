"""Pixel tables (sample_id, v, u, channels): masks, morphology, depth statistics, comparisons. Absent pixels are outside the frame."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions.expr import hash_normal, unproject
from reconlake.operators.neighbours import nn_join
from reconlake.operators.quantiles import quantiles, with_quantiles
from reconlake.operators.select import midpoint_strata
from reconlake.operators.tiles import convolved, eroded, extreme, gaussian_kernel, inner, shifted, tiled
from reconlake.plans.lineage import stored

KEY = ["sample_id", "v", "u"]


def _emit(px: DataFrame, offsets: list[tuple[int, int]], cols: list[str]) -> DataFrame:
    """Rows of px given to the pixels that have them as neighbours at these offsets."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("dv"), F.lit(j).alias("du")) for i, j in offsets]))
    rows = px.select(*KEY, *cols, o.alias("_o"))
    return rows.select("sample_id", (F.col("v") + F.col("_o.dv")).alias("v"), (F.col("u") + F.col("_o.du")).alias("u"), *cols)


def mask_stats(px: DataFrame, mask: str = "mask", height: int = 480, width: int = 640) -> DataFrame:
    """Per sample with a masked pixel: area, box, fill of the box, border contact, centre offset from the frame's centre."""
    m = px.where(mask).groupBy("sample_id").agg(
        F.count("*").alias("area"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.min("u").alias("u_min"), F.max("u").alias("u_max"),
        F.count_if((F.col("v") == 0) | (F.col("u") == 0) | (F.col("v") == height - 1) | (F.col("u") == width - 1)).alias("border"), F.avg("v").alias("_v"), F.avg("u").alias("_u"),
    )
    box = (F.col("v_max") - F.col("v_min") + 1) * (F.col("u_max") - F.col("u_min") + 1)
    dv, du = F.col("_v") - (height - 1) / 2, F.col("_u") - (width - 1) / 2
    return m.withColumn("fill", F.col("area") / box).withColumn("centre_offset", F.sqrt(dv * dv + du * du)).drop("_v", "_u")


def erode(px: DataFrame, n: int = 1, mask: str = "mask", border: bool = False) -> DataFrame:
    """Masked pixels that remain after n erosions with the four neighbours. Outside the frame counts as `border`.

    With border, pixels that aren't in the table count as masked; then the table must hold the whole frame.
    """

    def kept(present, masked):
        masked = np.where(present, masked, border)
        return inner(present & eroded(masked, n, border), n), []

    return tiled(px, [mask], n, kept, "")


def boundary(px: DataFrame, n: int = 1, mask: str = "mask") -> DataFrame:
    """Masked pixels that n erosions take away."""
    return px.where(mask).select(*KEY).join(erode(px, n, mask), KEY, "left_anti")


def local_range(px: DataFrame, k: int = 5, value: str = "depth") -> DataFrame:
    """Largest minus smallest value of the k x k pixels around each pixel; missing values count as 0."""
    r = k // 2

    def ranges(present, x):
        most, least = (extreme(np.where(present, x, e), r, best, e) for best, e in ((np.maximum, -np.inf), (np.minimum, np.inf)))
        return inner(present, r), [inner(np.where(present, most - least, 0.0), r)]

    return tiled(px.withColumn("_x", F.coalesce(F.col(value), F.lit(0.0))), ["_x"], r, ranges, "range double")


def laplacian(px: DataFrame, value: str) -> DataFrame:
    """Sum of the four neighbours minus four times the pixel, where all five are defined."""

    def residuals(present, x):
        defined = eroded(present, 1, False)
        near = sum(shifted(x, dv, du, 0.0) for dv, du in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        return inner(defined, 1), [inner(near - 4 * x, 1)]

    return tiled(px.where(F.col(value).isNotNull()), [value], 1, residuals, "residual double")


def depth_noise(px: DataFrame, interior: int = 3, patch: int = 2, span: float = 0.01) -> DataFrame:
    """Per sample the noise coefficient of depth: scaled median absolute deviation of the Laplacian of inverse depth on smooth
    interior patches, and how many pixels it rests on."""
    valid = F.coalesce(F.col("depth") > 0, F.lit(False))
    inside = erode(px, interior)
    base = px.select(*KEY, "depth").join(inside, KEY, "left_semi").withColumn("mask", valid)
    smooth = erode(base, patch).join(local_range(px, 5).where(F.col("range") < span), KEY, "left_semi")
    inverse = px.select(*KEY, F.when(valid, 1 / F.col("depth")).otherwise(0.0).alias("inverse"))
    res = laplacian(inverse, "inverse").join(smooth, KEY, "left_semi")
    mid = quantiles(res, ["sample_id"], "residual", {"_m": 0.5})
    res = res.join(mid, "sample_id").withColumn("_d", F.abs(F.col("residual") - F.col("_m")))
    # fixed value: normal deviation of one median absolute deviation, and the kernel's norm
    out = with_quantiles(res.groupBy("sample_id").agg(F.count("*").alias("pixels")), res, ["sample_id"], "_d", {"_mad": 0.5})
    return out.select("sample_id", (F.col("_mad") / (0.6744897501960817 * 20**0.5)).alias("sigma_inverse"), "pixels")


def missing_rates(px: DataFrame, n: int = 3) -> DataFrame:
    """Share of pixels without depth inside the mask's interior and on its boundary; null for an empty part."""
    rows = px.where("mask").join(erode(px, n).withColumn("_in", F.lit(True)), KEY, "left").withColumn("_miss", (~F.coalesce(F.col("depth") > 0, F.lit(False))).cast("double"))
    return rows.groupBy("sample_id").agg(F.avg(F.when(F.col("_in"), F.col("_miss"))).alias("interior"), F.avg(F.when(F.col("_in").isNull(), F.col("_miss"))).alias("boundary"))


def correlated_field(samples: DataFrame, height: int, width: int, sigma: float, seed: str) -> DataFrame:
    """(sample_id, v, u, field): normal draws of every pixel of the frame, smoothed by a normal curve of `sigma` pixels.

    Draws are mirrored at the frame's edges, the edge pixel included.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    mirrored = lambda c, n: F.when(F.pmod(c, F.lit(2 * n)) < n, F.pmod(c, F.lit(2 * n))).otherwise(2 * n - 1 - F.pmod(c, F.lit(2 * n)))
    grid = samples.select("sample_id").distinct().withColumn("v", F.explode(F.sequence(F.lit(-r), F.lit(height - 1 + r)))).withColumn("u", F.explode(F.sequence(F.lit(-r), F.lit(width - 1 + r))))
    grid = grid.withColumn("_f", hash_normal(seed, "sample_id", mirrored(F.col("v"), height), mirrored(F.col("u"), width)))

    def smoothed(present, f):
        return inner(present, r), [inner(convolved(np.where(present, f, 0.0), kernel), r)]

    return tiled(grid, ["_f"], r, smoothed, "field double").where(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))


def corrupt_depth(px: DataFrame, noise: float, step: float, interior: float, boundary_: float, height: int = 480, width: int = 640, sigma: float | None = None, seed: str = "depth") -> DataFrame:
    """Px with depth as a sensor has it, by measured statistics: noise coefficient of inverse depth, step, and invalid rates.

    Normal noise grows with the square of depth; depth is rounded to steps. Pixels drop out where a correlated field is below its
    quantile at the invalid rate, which is one for the mask's boundary, max(1, 3 height / 480) erosions wide, and one for all other
    pixels; quantiles are over the whole frame. Depths that are null, not finite or not above 0 become 0. sigma, in pixels: the
    field's smoothing, by default 1.5 height / 480. Pixels outside of the frame are not allowed.
    """
    field = stored(correlated_field(px, height, width, sigma or 1.5 * height / 480, seed + "/dropout"), "field")
    cuts = quantiles(field, ["sample_id"], "field", {"_interior": interior, "_boundary": boundary_})
    edge = boundary(px, max(1, round(3 * height / 480))).select(*KEY, F.lit(True).alias("_edge"))
    depth = F.col("depth").cast("double")
    noisy = depth + noise * depth * depth * hash_normal(seed + "/noise", *KEY)
    valid = F.coalesce((depth > 0) & (depth < float("inf")), F.lit(False))
    rows = px.join(field, KEY).join(cuts, "sample_id").join(edge, KEY, "left")
    missing = F.col("field") < F.when(F.coalesce("_edge", F.lit(False)), F.col("_boundary")).otherwise(F.col("_interior"))
    return rows.withColumn("depth", F.when(valid & ~missing, F.rint(noisy / step) * step).otherwise(0.0)).drop("field", "_interior", "_boundary", "_edge")


def observation_filter(px: DataFrame, radius: float = 0.25, least: int = 512, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Masked pixels with depth within `radius` of their sample's median and inside the range, for samples with enough of them."""
    good = px.where(F.col("mask") & (F.col("depth") > 0))
    mid = quantiles(good, ["sample_id"], "depth", {"_m": 0.5})
    rows = good.join(mid, "sample_id").where((F.abs(F.col("depth") - F.col("_m")) <= radius) & (F.col("depth") > low) & (F.col("depth") <= high)).drop("_m")
    enough = rows.groupBy("sample_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(enough.select("sample_id"), "sample_id", "left_semi")


def pixels_to_cloud(px: DataFrame, cams: DataFrame, n: int | None = None) -> DataFrame:
    """Camera points of pixels with depth; with n, the midpoint strata of each sample's pixels in row order."""
    rows = px.where(F.col("depth") > 0)
    if n:
        rows = midpoint_strata(rows, ["sample_id"], ["v", "u"], n)
    rows = rows.join(cams.select("sample_id", "fx", "fy", "cx", "cy"), "sample_id")
    x, y, z = unproject("u", "v", "depth", "fx", "fy", "cx", "cy")
    return rows.select("sample_id", "v", "u", x.alias("x"), y.alias("y"), z.alias("z"))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of two masks of each sample; null where both are empty. Pixels are met by grouping, not joined."""
    both = a.where("mask").select(*KEY, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.where("mask").select(*KEY, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    one = both.groupBy(*KEY).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    every = a.select("sample_id").unionByName(b.select("sample_id")).distinct()
    iou = one.groupBy("sample_id").agg((F.sum(F.col("_a") * F.col("_b")) / F.count("*")).alias("iou"))
    return every.join(iou, "sample_id", "left")


def boundary_p95(a: DataFrame, b: DataFrame) -> DataFrame:
    """95 % quantile of pixel distances from each mask's boundary to the other's; null if either is empty."""
    x = boundary(a).withColumn("p", F.concat_ws("_", "v", "u"))
    y = boundary(b).withColumn("p", F.concat_ws("_", "v", "u"))
    way = lambda s, t, name: quantiles(nn_join(s, t.withColumnRenamed("p", "o"), ["sample_id"], "p", "o", ("v", "u")), ["sample_id"], "distance", {name: 0.95})
    return way(x, y, "a_to_b").join(way(y, x, "b_to_a"), "sample_id", "full_outer")


def silhouette_pass(iou: str = "iou", ab: str = "a_to_b", ba: str = "b_to_a", min_iou: float = 0.98, max_p95: float = 3.0) -> Column:
    """The screen's verdict; undefined distances fail."""
    return F.coalesce((F.col(iou) >= min_iou) & (F.greatest(ab, ba) <= max_p95) & F.col(ab).isNotNull() & F.col(ba).isNotNull(), F.lit(False))


def rgb_changes(px: DataFrame, width: int, height: int, multiple: int = 14) -> DataFrame:
    """Shares of pixels whose colour differs between source and edit (sr .. eb): in the frame, in the mask, and in the centre crop
    to multiples of `multiple` that a model sees."""
    changed = reduce(lambda p, q: p | q, [~F.col(f"s{c}").eqNullSafe(F.col(f"e{c}")) for c in "rgb"])
    cw, ch = width // multiple * multiple, height // multiple * multiple
    left, top = (width - cw) // 2, (height - ch) // 2
    seen = F.col("u").between(left, left + cw - 1) & F.col("v").between(top, top + ch - 1)
    c = changed.cast("double")
    return px.groupBy("sample_id").agg(F.avg(c).alias("frame"), F.avg(F.when(F.col("mask"), c)).alias("masked"), F.avg(F.when(seen, c)).alias("model_visible"))


def observation_stats(px: DataFrame) -> DataFrame:
    """Occupied share of the frame and missing depth within the mask, in percent."""
    miss = ~F.coalesce(F.col("depth") > 0, F.lit(False))
    return px.groupBy("sample_id").agg((100 * F.avg(F.col("mask").cast("double"))).alias("occupancy"), (100 * F.avg(F.when(F.col("mask"), miss.cast("double")))).alias("missing"))


def depth_control(px: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Px with grey 0-255: inverse depth stretched between two quantiles of the sample; missing depth is 0."""
    inv = px.where(F.col("depth") > 0).withColumn("_i", 1 / F.col("depth"))
    q = quantiles(inv, ["sample_id"], "_i", {"_lo": low, "_hi": high})
    rows = px.join(q, "sample_id", "left")
    share = (1 / F.col("depth") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    grey = F.rint(255 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("grey", F.when(F.col("depth") > 0, grey).otherwise(0).cast("int")).drop("_lo", "_hi")


def composite(target: DataFrame, context: DataFrame, channels: list[str]) -> DataFrame:
    """Context pixels, replaced by the target's where its mask is set."""
    t = target.where("mask").select(*KEY, *[F.col(c).alias(f"_{c}") for c in channels], F.lit(True).alias("_m"))
    rows = context.join(t, KEY, "left")
    return rows.select(*KEY, *[F.when(F.col("_m"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in channels])


def mask_prompt(px: DataFrame, height: int, width: int, margin: float = 0.1) -> DataFrame:
    """F16: the mask's box grown by a share of its size and clamped, and the innermost pixel: farthest from any pixel outside, first in
    row order among equals."""
    box = px.where("mask").groupBy("sample_id").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("u").alias("u0"), F.max("u").alias("u1"))
    mv, mu = margin * (F.col("v1") - F.col("v0") + 1), margin * (F.col("u1") - F.col("u0") + 1)
    grown = box.select("sample_id", F.greatest(F.col("v0") - mv, F.lit(0.0)).alias("top"), F.least(F.col("v1") + mv, F.lit(float(height - 1))).alias("bottom"), F.greatest(F.col("u0") - mu, F.lit(0.0)).alias("left"), F.least(F.col("u1") + mu, F.lit(float(width - 1))).alias("right"))
    inside = px.where("mask").withColumn("p", F.col("v") * width + F.col("u"))
    outside = px.where("not mask").withColumn("o", F.col("v") * width + F.col("u"))
    far = nn_join(inside, outside, ["sample_id"], "p", "o", ("v", "u"))
    best = far.groupBy("sample_id").agg(F.max(F.struct("distance", (-F.col("p")).alias("n")))["n"].alias("_n"))
    return grown.join(best, "sample_id").select("sample_id", "top", "bottom", "left", "right", F.floor(-F.col("_n") / width).alias("v"), (-F.col("_n") % width).alias("u"))


def neutral_rgb(px: DataFrame, value: int = 128) -> DataFrame:
    """masked pixels in neutral grey."""
    return px.select(*[F.when(F.col("mask"), F.lit(value)).otherwise(F.col(c)).alias(c) if c in ("r", "g", "b") else F.col(c) for c in px.columns])


def photometric(px: DataFrame, seed: str) -> DataFrame:
    """brightness, contrast about the mean grey, saturation and gamma, each drawn by the sample's hash."""
    from reconlake.functions.expr import hash_uniform

    draw = lambda k, low, high: low + (high - low) * hash_uniform(f"{seed}/{k}", "sample_id")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))
    grey = lambda c: 0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"]
    rows = px.withColumns({f"_{c}": clip(F.col(c) * draw("brightness", 0.8, 1.2)) for c in "rgb"})
    mean = rows.groupBy("sample_id").agg(F.avg(grey({c: F.col(f"_{c}") for c in "rgb"})).alias("_mean"))
    rows = rows.join(mean, "sample_id")
    rows = rows.withColumns({f"_{c}": clip(F.col("_mean") + (F.col(f"_{c}") - F.col("_mean")) * draw("contrast", 0.8, 1.2)) for c in "rgb"})
    rows = rows.withColumn("_grey", grey({c: F.col(f"_{c}") for c in "rgb"}))
    rows = rows.withColumns({f"_{c}": clip(F.col("_grey") + (F.col(f"_{c}") - F.col("_grey")) * draw("saturation", 0.8, 1.2)) for c in "rgb"})
    done = {c: F.rint(255 * F.pow(F.col(f"_{c}") / 255, draw("gamma", 0.9, 1.1))).cast("int") for c in "rgb"}
    return rows.withColumns(done).drop("_r", "_g", "_b", "_mean", "_grey")


def block_downsample(px: DataFrame, k: int = 3, channels: tuple[str, ...] = ("r", "g", "b"), letterbox: int = 0) -> DataFrame:
    """k x k blocks: depth of the centre, mean colours rounded, a mask that all pixels share. letterbox rows come above."""
    centre = (F.col("v") % k == k // 2) & (F.col("u") % k == k // 2)
    out = px.groupBy("sample_id", F.floor(F.col("v") / k).alias("_v"), F.floor(F.col("u") / k).alias("_u")).agg(
        F.max(F.when(centre, F.col("depth"))).alias("depth"), (F.bool_and("mask") & (F.count("*") == k * k)).alias("mask"), *[F.rint(F.avg(c)).cast("int").alias(c) for c in channels]
    )
    return out.select("sample_id", (F.col("_v") + letterbox).alias("v"), F.col("_u").alias("u"), "depth", "mask", *channels)


def crop_box(px: DataFrame, height: int, width: int, margin: float = 1.4) -> DataFrame:
    """a 4:3 box of whole fours around each mask, grown by margin and moved inside the frame."""
    b = px.where("mask").groupBy("sample_id").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("u").alias("u0"), F.max("u").alias("u1"))
    want = F.greatest((F.col("u1") - F.col("u0") + 1) * margin, (F.col("v1") - F.col("v0") + 1) * margin * 4 / 3)
    w = F.least(F.lit(width), 4 * F.ceil(want / 4)).cast("long")
    b = b.withColumn("_w", w).withColumn("_h", F.floor(F.col("_w") * 3 / 4))
    at = lambda lo, hi, size, most: F.greatest(F.lit(0), F.least(F.floor((F.col(lo) + F.col(hi) + 1 - F.col(size)) / 2), most - F.col(size)))
    b = b.withColumn("left", at("u0", "u1", "_w", F.lit(width))).withColumn("top", at("v0", "v1", "_h", F.lit(height)))
    return b.select("sample_id", "left", "top", (F.col("left") + F.col("_w")).alias("right"), (F.col("top") + F.col("_h")).alias("bottom"))


def crop_intrinsics(boxes: DataFrame, cams: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """cameras of the crops, resized to width x height; pixel centres stay centres."""
    sx, sy = width / (F.col("right") - F.col("left")), height / (F.col("bottom") - F.col("top"))
    rows = boxes.join(cams.select("sample_id", "fx", "fy", "cx", "cy"), "sample_id")
    return rows.select("sample_id", (F.col("fx") * sx).alias("fx"), (F.col("fy") * sy).alias("fy"), (sx * (F.col("cx") - F.col("left") + 0.5) - 0.5).alias("cx"), (sy * (F.col("cy") - F.col("top") + 0.5) - 0.5).alias("cy"))


def nearest_map(px: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(sample_id, v, u, source_v, source_u): the nearest source pixel of each pixel of the resized crop that is in px."""
    at = lambda c, lo, hi, n: F.floor(F.col(lo) + (F.col(c) + 0.5) * (F.col(hi) - F.col(lo)) / n)
    rows = px.select(*KEY).join(boxes, "sample_id")
    return rows.select(*KEY, at("v", "top", "bottom", height).alias("source_v"), at("u", "left", "right", width).alias("source_u"))


def mask_components(px: DataFrame) -> DataFrame:
    """Per sample the 4-connected parts of its mask, with their pixels."""
    from reconlake.operators.graph import connected_components

    m = px.where("mask").select(*KEY).withColumn("node", F.struct(*KEY))
    edges = _emit(m, [(0, 1), (1, 0)], ["node"]).withColumnRenamed("node", "src").join(m.withColumnRenamed("node", "dst"), KEY).select("src", "dst")
    comp = connected_components(edges)
    parts = m.join(comp, "node", "left").select("sample_id", F.coalesce("component", "node").alias("part"))
    return parts.groupBy("sample_id", "part").agg(F.count("*").alias("pixels"))


