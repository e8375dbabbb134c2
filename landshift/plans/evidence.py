"""Evidence of every registered pair: masks, labels, footprints, areas, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landshift.functions import constants as K
from landshift.operators import change as D, quality as Q, raster as R
from landshift.session import cut_lineage


def pair_evidence(pixels: DataFrame, pairs: DataFrame, model: dict, extents: DataFrame, minimum_area: float = 2.0) -> DataFrame:
    """One row per pair, failed pairs included.

    ``pixels``: pair_id, row, col, old_b*, new_b*. ``model``: weights, bias, mean, std.
    ``pairs``: registration columns, warnings, old_status, new_status. ``extents``: pair_id,
    width, height, transform, factor. The model score and the segmentation confidence are the
    same number, the mean of all probabilities. A pair whose old or new mask has no footprint
    fails; it is not "no change".
    """
    bands = [f"b{i}" for i in range(1, len(model["weights"]) + 1)]

    def side(name: str) -> DataFrame:
        part = pixels.select("pair_id", "row", "col", *[F.col(f"{name}_{b}").alias(b) for b in bands], F.lit(name).alias("side"))
        return D.segment(part, model["weights"], model["bias"], model["mean"], model["std"], bands)

    both = cut_lineage(side("old").unionByName(side("new")).select("pair_id", "side", "row", "col", "probability", "predicted"))
    seg = both.groupBy("pair_id").agg(F.avg("probability").alias("segmentation_confidence"))
    masks = both.groupBy("pair_id", "row", "col").agg(
        F.max(F.when(F.col("side") == "old", F.col("predicted"))).alias("old_mask"),
        F.max(F.when(F.col("side") == "new", F.col("predicted"))).alias("new_mask"))
    labels = cut_lineage(D.mask_difference(masks, pairs))
    sides = F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side")
    observed = R.component_footprints(
        both.where("predicted = 1").select("pair_id", "side", "row", "col"),
        extents.select("*", sides), ("pair_id", "side"), minimum_area,
    ).groupBy("pair_id").agg(F.count_distinct("side").alias("_sides"))
    kinds = F.explode(F.array(*[F.lit(k) for k in (K.ADDED, K.REMOVED, K.EXPANSION, K.PARTIAL_DEMOLITION)])).alias("label")
    polygons = R.component_footprints(
        labels.select("pair_id", "label", "row", "col"), extents.select("*", kinds), ("pair_id", "label"), minimum_area,
    ).groupBy("pair_id").agg(F.count("*").alias("polygons"), F.sum("area_m2").alias("changed_area"))
    counts = labels.groupBy("pair_id").agg(F.count("*").alias("changed_pixels"))
    wide = (
        pairs.join(seg, "pair_id").join(observed, "pair_id", "left")
        .join(polygons, "pair_id", "left").join(counts, "pair_id", "left")
    )
    changed = F.coalesce("changed_pixels", F.lit(0))
    worst = F.greatest(Q.status_rank(F.col("old_status")), Q.status_rank(F.col("new_status")))
    error = F.coalesce(
        F.when(D.registration_error(K.MASK_DIFFERENCE["min_score"]).isNotNull(), "REGISTRATION_FAILED"),
        F.when(F.coalesce("_sides", F.lit(0)) < 2, "REGISTRATION_QUALITY_TOO_LOW"))
    return wide.select(
        "pair_id", error.alias("error_code"), changed.alias("changed_pixels"),
        F.coalesce("polygons", F.lit(0)).alias("polygons"), F.coalesce("changed_area", F.lit(0.0)).alias("changed_area"),
        F.col("segmentation_confidence"),
        D.change_confidence(F.col("segmentation_confidence"), F.col("score"), F.size("warnings"), changed,
                            F.col("segmentation_confidence")).alias("change_confidence"),
        F.get(F.array(*[F.lit(s) for s in K.QUALITY_STATUSES]), (worst - 1).cast("int")).alias("image_status"))
