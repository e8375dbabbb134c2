"""Change detection on registered pairs: differences, labels, confidence, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import clamp, codes
from landshift.operators import raster as R

PAIR = ("pair_id",)


def registration_error(minimum: float) -> Column:
    """Why a pair may not be compared, else null. Needs the registration columns of a pair."""
    return F.when(~F.col("transform_plausible") | (F.col("overlap_ratio") <= 0), "REGISTRATION_INVALID").when(
        F.col("score") < minimum, "REGISTRATION_TOO_LOW")


def usable_pairs(pairs: DataFrame, minimum: float) -> DataFrame:
    return pairs.where(registration_error(minimum).isNull())


def _gray(prefix: str, bands: int) -> Column:
    total = F.col(f"{prefix}_b1").cast("double")
    for i in range(2, bands + 1):
        total = total + F.col(f"{prefix}_b{i}")
    return total / float(bands) / 255.0


def difference_score(pixels: DataFrame, mode: str = "pixel", bands: int = 3, key: R.Key = PAIR) -> DataFrame:
    """Adds ``difference`` in 0..1 from old_b*/new_b*: absolute gray difference or structure."""
    gray = pixels.withColumn("_o", _gray("old", bands)).withColumn("_n", _gray("new", bands))
    if mode == "pixel":
        return gray.withColumn("difference", F.abs(F.col("_n") - F.col("_o"))).drop("_o", "_n")
    o, n = F.col("_o"), F.col("_n")
    wide = gray.withColumn("_oo", o * o).withColumn("_nn", n * n).withColumn("_on", o * n)
    s = R.gaussian5(wide, ["_o", "_n", "_oo", "_nn", "_on"], key)
    c1, c2 = K.SSIM_C1, K.SSIM_C2
    vo, vn, cov = F.col("_oo") - o * o, F.col("_nn") - n * n, F.col("_on") - o * n
    similarity = ((2 * o * n + c1) * (2 * cov + c2)) / ((o * o + n * n + c1) * (vo + vn + c2))
    return s.withColumn("difference", clamp((1 - similarity) / 2, 0, 1)).drop("_o", "_n", "_oo", "_nn", "_on")


def image_difference(
    pixels: DataFrame, pairs: DataFrame, mode: str = "pixel", bands: int = 3, cfg: dict = K.IMAGE_DIFFERENCE,
) -> tuple[DataFrame, DataFrame]:
    """(labelled pixels, one result row per pair).

    The threshold rises as registration gets worse; every surviving pixel is an uncertain change. A pair
    that may not be compared has an error code and no figures.
    """
    usable = usable_pairs(pairs, cfg["min_score"])
    threshold = F.least(F.lit(1.0), cfg["threshold"] + cfg["penalty"] * (1 - F.col("score")))
    limits = usable.select("pair_id", threshold.alias("_t"))
    scored = difference_score(pixels.join(limits, "pair_id"), mode, bands)
    mask = scored.withColumn("_mask", (F.col("difference") >= F.col("_t")).cast("int"))
    clean = R.open_close(mask, "_mask", cfg["kernel"], PAIR)
    kept = R.drop_small(
        R.pixel_components(clean.where("_mask = 1").select("pair_id", "row", "col", "difference"), PAIR),
        cfg["min_region"], PAIR)
    labels = kept.select("pair_id", "row", "col", "component", "difference", F.lit(K.UNCERTAIN).alias("label"))
    changed = kept.groupBy("pair_id").agg(F.count("*").alias("changed_pixels"), F.avg("difference").alias("_in"))
    overall = scored.groupBy("pair_id").agg(F.avg("difference").alias("_all"))
    error = registration_error(cfg["min_score"])
    ok = error.isNull()
    result = pairs.join(overall, "pair_id", "left").join(changed, "pair_id", "left").select(
        "pair_id", error.alias("error_code"),
        F.when(ok, F.coalesce("changed_pixels", F.lit(0))).alias("changed_pixels"),
        F.when(ok, F.coalesce(F.col("_in"), 1 - F.col("_all"))).alias("model_score"),
        F.when(ok, codes((F.col("score") < K.TIER_MEDIUM, "REGISTRATION_QUALITY_REDUCED"))).alias("warnings"))
    return labels, result


def mask_difference(pixels: DataFrame, pairs: DataFrame, cfg: dict = K.MASK_DIFFERENCE) -> DataFrame:
    """Labelled changed pixels from old_mask/new_mask.

    Added and removed pixels never coincide, so one component pass labels both: the kind is part
    of the component key. A component next to the common footprint is an expansion or a partial
    demolition; the common footprint is taken before small regions go.
    """
    usable = usable_pairs(pairs, cfg["min_score"]).select("pair_id")
    o, n = F.col("old_mask") > 0, F.col("new_mask") > 0
    grid = pixels.join(usable, "pair_id", "left_semi").select(
        "pair_id", "row", "col",
        F.when(n & ~o, 1).when(o & ~n, 2).otherwise(0).alias("kind"), (o & n).cast("int").alias("_near"))
    if cfg["adjacency"]:
        grid = R.dilate(grid, "_near", cfg["adjacency"], PAIR)
    key = ("pair_id", "kind")
    parts = R.drop_small(R.pixel_components(grid.where("kind > 0"), key), cfg["min_region"], key)
    joined = parts.groupBy(*key, "component").agg(F.max("_near").alias("_touch"))
    label = (
        F.when((F.col("kind") == 1) & (F.col("_touch") == 1), K.EXPANSION)
        .when(F.col("kind") == 1, K.ADDED)
        .when(F.col("_touch") == 1, K.PARTIAL_DEMOLITION).otherwise(K.REMOVED)
    )
    return parts.join(joined, [*key, "component"]).select("pair_id", "row", "col", "kind", "component", label.alias("label"))


def changed_area(labels: DataFrame, pixels: DataFrame, pairs: DataFrame, min_score: float = K.MASK_DIFFERENCE["min_score"]) -> DataFrame:
    """Added, removed and common pixels and square metres of every pair; an error code where it may not be compared."""
    counts = labels.groupBy("pair_id").agg(
        F.count_if(F.col("label").isin(K.ADDED, K.EXPANSION)).alias("added_pixels"),
        F.count_if(F.col("label").isin(K.REMOVED, K.PARTIAL_DEMOLITION)).alias("removed_pixels"))
    common = pixels.groupBy("pair_id").agg(
        F.count_if((F.col("old_mask") > 0) & (F.col("new_mask") > 0)).alias("common_pixels"))
    a, r = F.coalesce("added_pixels", F.lit(0)), F.coalesce("removed_pixels", F.lit(0))
    error = registration_error(min_score)
    values = {"added_pixels": a, "removed_pixels": r, "common_pixels": F.col("common_pixels"),
              "added_area": a * F.col("pixel_area"), "removed_area": r * F.col("pixel_area")}
    return pairs.join(common, "pair_id", "left").join(counts, "pair_id", "left").select(
        "pair_id", error.alias("error_code"), *[F.when(error.isNull(), v).alias(name) for name, v in values.items()])


def change_confidence(
    model_score: Column, quality: Column, warning_count: Column, changed_pixels: Column,
    segmentation: Column | None = None, cfg: dict = K.CONFIDENCE,
) -> Column:
    """Product of score and factors for registration, warnings, size and segmentation, in 0..1."""
    span = max(1, cfg["full_region"] - cfg["min_region"])
    size = (
        F.when(changed_pixels == 0, 1.0).when(changed_pixels < cfg["min_region"], 0.35)
        .otherwise(F.least(F.lit(1.0), 0.6 + 0.4 * (changed_pixels - cfg["min_region"]) / span))
    )
    warned = F.greatest(F.lit(0.0), 1 - warning_count * cfg["warning_penalty"])
    seg = F.lit(1.0) if segmentation is None else F.coalesce(0.5 + 0.5 * segmentation, F.lit(1.0))
    return clamp(model_score * (0.2 + 0.8 * quality) * warned * size * seg, 0, 1)


def logistic(logit: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(logit, -30, 30)))


def segment(pixels: DataFrame, weights: list[float], bias: float, mean: list[float], std: list[float],
            bands: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds probability and prediction of a linear model on normalised bands."""
    logit: Column = F.lit(0.0)
    for w, m, s, b in zip(weights, mean, std, bands):
        logit = logit + (F.col(b) / 255.0 - m) / s * w
    return pixels.withColumn("probability", logistic(logit + bias)).withColumn(
        "predicted", (F.col("probability") >= threshold).cast("int"))


def difference_features(bands: int = 3) -> list[Column]:
    """Absolute band differences in 0..1, then the absolute mask difference."""
    visual = [F.abs(F.col(f"new_b{i}") / 255.0 - F.col(f"old_b{i}") / 255.0) for i in range(1, bands + 1)]
    return [*visual, F.abs(F.col("new_mask") - F.col("old_mask")).cast("double")]


def siamese(pixels: DataFrame, pairs: DataFrame, weights: list[float], bias: float, threshold: float = 0.5,
            min_score: float = 0.25, bands: int = 3) -> DataFrame:
    """Probability and label (uncertain change or none) of every pixel of the usable pairs."""
    logit: Column = F.lit(0.0)
    for w, x in zip(weights, difference_features(bands)):
        logit = logit + x * w
    usable = usable_pairs(pairs, min_score).select("pair_id")
    return pixels.join(usable, "pair_id", "left_semi").withColumn("probability", logistic(logit + bias)).withColumn(
        "label", F.when(F.col("probability") >= threshold, K.UNCERTAIN).otherwise(K.NO_CHANGE))
