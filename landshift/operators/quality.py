"""Raster and pair quality, reliability decisions, ingest, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import codes, uuid5_url
from landshift.operators import raster as R
from landshift.operators.spatial import pair_overlap, resolution_ratio

# Failure of the registration run -> (status, stage, reason).
RELIABILITY = {
    "raster_read": ("REJECTED", "ingestion", "UNREADABLE_RASTER"),
    "raster_metadata": ("REJECTED", "ingestion", "INVALID_RASTER_METADATA"),
    "crs_missing": ("REJECTED", "ingestion", "MISSING_CRS"),
    "crs_mismatch": ("REJECTED", "geospatial_alignment", "CRS_MISMATCH"),
    "insufficient_overlap": ("REJECTED", "geospatial_alignment", "INSUFFICIENT_GEOGRAPHIC_OVERLAP"),
    "registration_quality": ("REJECTED", "geospatial_alignment", "REGISTRATION_INPUT_REJECTED"),
    "registration": ("REQUIRES_MANUAL_ALIGNMENT", "visual_refinement", "VISUAL_REGISTRATION_FAILED"),
}
MAX_BYTES = 50 * 1024 * 1024
MAX_PIXELS = 100_000_000

REJECTED_CODES = (
    "MINIMUM_DIMENSIONS", "INCOMPATIBLE_BANDS", "INCOMPATIBLE_CHANNEL_ORDER", "LOW_VALID_PIXEL_RATIO",
    "EXCESSIVE_BLUR", "INSUFFICIENT_GEOGRAPHIC_OVERLAP",
)
MANUAL_CODES = ("LARGE_RESOLUTION_MISMATCH",)


def issue_status(issues: Column) -> Column:
    """Status by the worst severity among the issue codes."""
    rejected = F.arrays_overlap(issues, F.array(*[F.lit(c) for c in REJECTED_CODES]))
    manual = F.arrays_overlap(issues, F.array(*[F.lit(c) for c in MANUAL_CODES]))
    return (
        F.when(rejected, "REJECTED").when(manual, "REQUIRES_MANUAL_ALIGNMENT")
        .when(F.size(issues) > 0, "PASS_WITH_WARNING").otherwise("PASS")
    )


def status_rank(status: Column) -> Column:
    """Declared order of the statuses, for taking the worst."""
    return F.array_position(F.array(*[F.lit(s) for s in K.QUALITY_STATUSES]), status)


def raster_metrics(pixels: DataFrame, key: R.Key = ("raster_id",)) -> DataFrame:
    """Blur variance, dark, bright and valid ratios of 8-bit gray pixels (gray, valid)."""
    lap = R.laplacian(pixels.select(*key, "row", "col", "gray", "valid"), "gray", key)
    ok, n = F.col("valid"), F.count_if("valid")
    x = F.when(ok, F.col("laplacian").cast("double"))
    share = lambda cond: F.when(n > 0, F.count_if(ok & cond) / n)
    return lap.groupBy(*key).agg(
        F.coalesce(F.var_pop(x), F.lit(0.0)).alias("blur_variance"),
        F.coalesce(share(F.col("gray") <= K.QUALITY["dark"]), F.lit(1.0)).alias("dark_ratio"),
        F.coalesce(share(F.col("gray") >= K.QUALITY["bright"]), F.lit(0.0)).alias("bright_ratio"),
        (n / F.count("*")).alias("valid_ratio"),
    )


def raster_quality(metrics: DataFrame, meta: DataFrame, cfg: dict = K.QUALITY, key: R.Key = ("raster_id",)) -> DataFrame:
    """Issue codes in check order and the resulting status."""
    c = F.col
    rgb = F.slice("channel_order", 1, 3) == F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    issues = codes(
        (F.least("width", "height") < cfg["min_side"], "MINIMUM_DIMENSIONS"),
        (~c("band_count").isin(*cfg["bands"]), "INCOMPATIBLE_BANDS"),
        ((c("band_count") >= 3) & ~rgb, "INCOMPATIBLE_CHANNEL_ORDER"),
        (c("valid_ratio") < cfg["valid"], "LOW_VALID_PIXEL_RATIO"),
        (c("blur_variance") < cfg["blur"], "EXCESSIVE_BLUR"),
        (c("dark_ratio") >= cfg["exposure"], "EXTREME_DARKNESS"),
        (c("bright_ratio") >= cfg["exposure"], "EXTREME_OVEREXPOSURE"),
    )
    return metrics.join(meta, list(key)).withColumn("issues", issues).withColumn("status", issue_status(F.col("issues")))


def pair_quality(pairs: DataFrame, cfg: dict = K.QUALITY) -> DataFrame:
    """Overlap, resolution ratio, issues and status of pairs.

    Needs old_box, new_box, old_res, new_res, old_bands, new_bands (same CRS for both).
    """
    wide = pairs.withColumn("geographic_overlap", pair_overlap(F.col("old_box"), F.col("new_box"))).withColumn(
        "resolution_ratio", resolution_ratio(F.col("old_res"), F.col("new_res")))
    issues = codes(
        (F.col("geographic_overlap") < cfg["overlap"], "INSUFFICIENT_GEOGRAPHIC_OVERLAP"),
        (F.col("resolution_ratio") > cfg["resolution_ratio"], "LARGE_RESOLUTION_MISMATCH"),
        (F.col("old_bands") != F.col("new_bands"), "INCOMPATIBLE_BANDS"),
    )
    return wide.withColumn("pair_issues", issues).withColumn("pair_status", issue_status(F.col("pair_issues")))


def registration_status(pairs: DataFrame) -> DataFrame:
    """Sorted warning set and final status of a pair, or why the run stopped.

    Needs old_issues, new_issues, pair_issues, pair_status, compute_status, compute_warnings.
    """
    rejected = F.array(*[F.lit(c) for c in REJECTED_CODES])
    inputs = F.array_union("old_issues", "new_issues")
    warnings = F.array_sort(F.array_distinct(F.concat(
        F.array_except(inputs, rejected), F.col("pair_issues"), F.col("compute_warnings"))))
    manual = F.lit("REQUIRES_MANUAL_ALIGNMENT")
    return (
        pairs.withColumn("failure", F.when(F.arrays_overlap(inputs, rejected), "registration_quality")
                         .when(F.array_contains("pair_issues", "INSUFFICIENT_GEOGRAPHIC_OVERLAP"), "insufficient_overlap")
                         .when(F.col("pair_status") == "REJECTED", "registration_quality"))
        .withColumn("warnings", warnings)
        .withColumn("status", F.when((F.col("compute_status") == manual) | (F.col("pair_status") == manual), manual)
                    .when(F.size("warnings") > 0, "PASS_WITH_WARNING").otherwise("PASS"))
    )


def reliability(pairs: DataFrame) -> DataFrame:
    """Stage and reason codes of every pair; a failure never reads as "no change".

    Needs failure (or null), status, warnings, visual_refinement_applied.
    """
    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, values in RELIABILITY.items():
            out = F.when(F.col("failure") == kind, values[i]).otherwise(out)
        return out

    failed = F.col("failure").isNotNull()
    good = ~failed & F.col("status").isin("PASS", "PASS_WITH_WARNING")
    reasons = F.when(good, F.col("warnings")).otherwise(
        F.array_union("warnings", F.array(F.lit("MANUAL_ALIGNMENT_REQUIRED"))))
    geo = F.array_contains(reasons, "LARGE_RESOLUTION_MISMATCH") | ~F.col("visual_refinement_applied")
    return (
        pairs.withColumn("reliable", good)
        .withColumn("decided_status", F.when(failed, pick(0)).otherwise(F.col("status")))
        .withColumn("failure_stage", F.when(failed, pick(1)).when(good, F.lit(None)).otherwise(
            F.when(geo, "geospatial_alignment").otherwise("visual_refinement")))
        .withColumn("reason_codes", F.when(failed, F.array(pick(2))).otherwise(F.array_sort(F.array_distinct(reasons))))
    )


def contrast_stretch(pixels: DataFrame, low: float = K.REGISTRATION["low_percentile"],
                     high: float = K.REGISTRATION["high_percentile"], key: R.Key = ("raster_id",)) -> DataFrame:
    """Adds ``stretched``: gray between two exact percentiles of the valid pixels scaled to 0..255.

    Percentiles come from the counts of distinct gray values (at most 65,536 per raster of 16-bit
    pixels), so no raster is ever gathered.
    """
    from pyspark.sql import Window

    k = list(key)
    counts = pixels.where("valid").groupBy(*k, "gray").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*k).orderBy("gray")
    placed = counts.withColumn("_end", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*k)))

    def value_at(place: Column) -> Column:
        return F.min(F.when(F.col("_end") > place, F.col("gray")))

    def percentile(p: float, name: str) -> list[Column]:
        at = (F.col("_all") - 1) * (p / 100.0)
        return [value_at(F.floor(at)).alias(f"_{name}a"), value_at(F.ceil(at)).alias(f"_{name}b"),
                F.max(at - F.floor(at)).alias(f"_{name}f")]

    limits = placed.groupBy(*k).agg(*percentile(low, "l"), *percentile(high, "h")).select(
        *k, (F.col("_la") + (F.col("_lb") - F.col("_la")) * F.col("_lf")).alias("low"),
        (F.col("_ha") + (F.col("_hb") - F.col("_ha")) * F.col("_hf")).alias("high"))
    span = F.col("high") - F.col("low")
    value = (F.col("gray") - F.col("low")) * (255.0 / F.when(span > 0, span))
    return pixels.join(limits, k, "left").withColumn(
        "stretched", F.coalesce(
            # The small addend keeps whole numbers whole in spite of division error.
            F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)) + 1e-9), F.lit(0)).cast("int"))


def ingest(
    incoming: DataFrame, stored: DataFrame, payload: list[str], max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS,
) -> DataFrame:
    """Ingest decision per incoming raster: new, same, conflict or the reason of refusal.

    ``max_bytes`` and ``max_pixels`` are rules of the deployment; a larger raster keeps its row with the reason.

    The id comes from municipality and content hash. Within a batch the first row of an id counts
    as stored for the later ones.
    """
    key = uuid5_url("asset", F.col("municipality_id"), F.col("content_sha256"))
    given = incoming.withColumn("asset_key", key).withColumn("_p", F.to_json(F.struct(*payload)))
    refused = (
        F.when(F.col("byte_size") > max_bytes, "TOO_MANY_BYTES")
        .when(F.col("pixel_count") > max_pixels, "TOO_MANY_PIXELS")
        .when(F.col("quality_status") == "REJECTED", "QUALITY_REJECTED")
    )
    judged = given.withColumn("_refused", refused)
    first = judged.where("_refused is null").groupBy("asset_key").agg(
        F.min_by(F.struct("_p", "ordinal"), "ordinal").alias("_first"))
    known = stored.withColumn("asset_key", key).select(
        "asset_key", F.to_json(F.struct(*payload)).alias("_stored"))
    base = F.coalesce("_stored", "_first._p")
    return (
        judged.join(first, "asset_key", "left").join(known, "asset_key", "left")
        .withColumn("state", F.when(F.col("_refused").isNotNull(), F.col("_refused"))
                    .when(F.col("_stored").isNull() & (F.col("ordinal") == F.col("_first.ordinal")), "new")
                    .when(F.col("_p") == base, "same").otherwise("conflict"))
        .drop("_p", "_refused", "_first", "_stored")
    )


def quality_snapshot(assets: DataFrame, failures: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: assets, assets below PASS, failures of two kinds, cases scored 50 or more."""
    a = assets.agg(F.count("*").alias("total_assets"), F.count_if(F.col("status") != "PASS").alias("low_quality_assets"))
    f = failures.agg(
        F.count_if(F.col("failure_code") == "REGISTRATION_FAILED").alias("registration_failures"),
        F.count_if(F.col("failure_code") == "MODEL_CHECKSUM_MISMATCH").alias("model_checksum_failures"))
    c = cases.agg(F.count_if(F.col("score") >= 50).alias("high_risk_cases"))
    one = F.lit(1).alias("_one")
    return a.select(one, "*").join(f.select(one, "*"), "_one").join(c.select(one, "*"), "_one").drop("_one")
