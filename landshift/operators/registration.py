"""Registration tables: descriptor matches, affine fits, plausibility, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions.constants import REGISTRATION
from landshift.functions.scalars import clamp, codes

BLOCK = 256


def _blocks(side: DataFrame, prefix: str) -> DataFrame:
    """Descriptors of a pair in blocks of about 256."""
    sizes = side.groupBy("pair_id").agg(F.ceil(F.count("*") / BLOCK).alias("_b"))
    block = F.pmod(F.xxhash64("feature_id"), F.col("_b"))
    return side.join(sizes, "pair_id").groupBy("pair_id", block.alias(f"{prefix}_block")).agg(
        F.collect_list(F.struct("feature_id", "descriptor")).alias(f"{prefix}_rows"))


def _two_nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two nearest right descriptors of each left one, within one pair of blocks."""
    for batch in batches:
        out = []
        for pair, left, right in zip(batch["pair_id"], batch["l_rows"], batch["r_rows"]):
            right = sorted(right, key=lambda r: r["feature_id"])
            a = np.frombuffer(b"".join(bytes(r["descriptor"]) for r in left), np.uint8).reshape(len(left), -1)
            b = np.frombuffer(b"".join(bytes(r["descriptor"]) for r in right), np.uint8).reshape(len(right), -1)
            d = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            for i, row in enumerate(left):
                out += [(pair, row["feature_id"], right[j]["feature_id"], int(d[i, j])) for j in order[i]]
        yield pd.DataFrame(out, columns=["pair_id", "left_id", "right_id", "distance"])


def ratio_test_matches(left: DataFrame, right: DataFrame, ratio: float = REGISTRATION["feature_ratio"]) -> DataFrame:
    """Nearest right feature of each left one, kept where clearly nearer than the second.

    Inputs: pair_id, feature_id, descriptor (binary, equal lengths). Blocks of features meet by
    pair, each meeting is one small bit-count matrix and sends on two rows per left feature.
    """
    met = _blocks(left, "l").join(_blocks(right, "r"), "pair_id").repartition("pair_id", "l_block", "r_block")
    types = dict(left.dtypes)
    near = met.select("pair_id", "l_rows", "r_rows").mapInPandas(
        _two_nearest,
        f"pair_id {types['pair_id']}, left_id {types['feature_id']}, right_id {dict(right.dtypes)['feature_id']}, distance int")
    best = near.groupBy("pair_id", "left_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "right_id"))), 1, 2).alias("_n"))
    first, second = F.get("_n", F.lit(0)), F.get("_n", F.lit(1))
    return best.where((F.size("_n") == 2) & (first["distance"] < ratio * second["distance"])).select(
        "pair_id", "left_id", first["right_id"].alias("right_id"), first["distance"].alias("distance"),
        second["distance"].alias("second_distance"))


def fit_affine(points: DataFrame) -> DataFrame:
    """Least-squares affine after -> before per pair: one grouped sum, then a closed-form solve.

    Points: pair_id, after_x, after_y, before_x, before_y.
    """
    x, y, u, v = (F.col(c) for c in ("after_x", "after_y", "before_x", "before_y"))
    names = {"x": x, "y": y, "u": u, "v": v, "xx": x * x, "xy": x * y, "yy": y * y,
             "xu": x * u, "yu": y * u, "xv": x * v, "yv": y * v}
    s = points.groupBy("pair_id").agg(F.count("*").alias("n"), *[F.sum(e).alias(f"s_{k}") for k, e in names.items()])
    n = F.col("n")

    def centred(a: str, b: str) -> Column:
        return F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n

    sxx, sxy, syy = centred("x", "x"), centred("x", "y"), centred("y", "y")
    det = sxx * syy - sxy * sxy
    fitted = s.select("*", F.when((n >= 3) & (det > 1e-9 * F.greatest(sxx * syy, F.lit(1e-9))), det).alias("_d"))

    def slopes(t: str) -> tuple[Column, Column, Column]:
        xt, yt = centred("x", t), centred("y", t)
        p, q = (xt * syy - yt * sxy) / F.col("_d"), (yt * sxx - xt * sxy) / F.col("_d")
        return p, q, F.col(f"s_{t}") / n - p * F.col("s_x") / n - q * F.col("s_y") / n

    a, b, c = slopes("u")
    d, e, f = slopes("v")
    return fitted.select(
        "pair_id", "n", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"),
        F.when(n < 3, "TOO_FEW_POINTS").when(F.col("_d").isNull(), "DEGENERATE_POINTS").alias("error_code"))


def transform_issues(width: Column, height: Column, cfg: dict = REGISTRATION,
                     perspective: tuple[Column, Column] | None = None) -> Column:
    """Codes of what makes a transform (a,b,c,d,e,f) implausible; empty where it is fine."""
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    finite = F.lit(True)
    for x in (a, b, c, d, e, f):
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    total = a * a + b * b + d * d + e * e
    split = F.sqrt(F.pow(a * a + b * b - d * d - e * e, 2) + 4 * F.pow(a * d + b * e, 2))
    big, small = F.sqrt((total + split) / 2), F.sqrt(F.greatest(F.lit(0.0), (total - split) / 2))
    scale = F.greatest(F.abs(big - 1), F.abs(small - 1))
    rotation = F.abs(F.degrees(F.atan2(d, a)))
    shift = F.sqrt(c * c + f * f) / F.sqrt(width * width + height * height)
    bent = F.lit(False)
    if perspective is not None:
        bent = F.greatest(F.abs(perspective[0]), F.abs(perspective[1])) > cfg["max_perspective"]
    return codes(
        (~F.coalesce(finite, F.lit(False)), "NOT_FINITE"), (bent, "PERSPECTIVE"), (a * e - b * d <= 0, "REFLECTION"),
        (scale > cfg["max_scale"], "SCALE"), (rotation > cfg["max_rotation"], "ROTATION"),
        (shift > cfg["max_translation"], "TRANSLATION"))


def residual() -> Column:
    """Distance of a projected after-point from its before-point."""
    u = F.col("a") * F.col("after_x") + F.col("b") * F.col("after_y") + F.col("c")
    v = F.col("d") * F.col("after_x") + F.col("e") * F.col("after_y") + F.col("f")
    return F.sqrt(F.pow(u - F.col("before_x"), 2) + F.pow(v - F.col("before_y"), 2))


def quality_score(inliers: Column, ratio: Column, error: Column, overlap: Column, cfg: dict = REGISTRATION) -> Column:
    return clamp(
        0.25 * F.least(F.lit(1.0), inliers / float(cfg["min_inliers"]))
        + 0.25 * F.least(F.lit(1.0), ratio / cfg["min_inlier_ratio"])
        + 0.25 * F.greatest(F.lit(0.0), 1.0 - error / cfg["max_error"])
        + 0.25 * overlap, 0, 1)


def registration_metrics(matches: DataFrame, transforms: DataFrame, cfg: dict = REGISTRATION) -> DataFrame:
    """Inliers, error, score and status per pair; transforms carry overlap_ratio."""
    r = residual()
    judged = matches.join(transforms, "pair_id").withColumn("_r", r).withColumn("_in", r <= cfg["ransac_px"])
    m = judged.groupBy("pair_id").agg(
        F.count("*").alias("matches"), F.count_if("_in").alias("inlier_count"),
        F.avg(F.when(F.col("_in"), F.col("_r"))).alias("reprojection_error"),
        F.max("overlap_ratio").alias("overlap_ratio"))
    wide = m.withColumn("inlier_ratio", F.col("inlier_count") / F.col("matches")).withColumn(
        "registration_score", quality_score(
            F.col("inlier_count"), F.col("inlier_ratio"), F.coalesce("reprojection_error", F.lit(cfg["max_error"])),
            F.col("overlap_ratio"), cfg))
    reliable = (
        (F.col("inlier_count") >= cfg["min_inliers"]) & (F.col("inlier_ratio") >= cfg["min_inlier_ratio"])
        & (F.col("reprojection_error") <= cfg["max_error"]) & (F.col("registration_score") >= cfg["min_score"]))
    return wide.withColumn(
        "error_code", F.when(F.col("matches") < cfg["min_inliers"], "INSUFFICIENT_MATCHES")
        .when(F.col("inlier_count") == 0, "NO_INLIERS")
    ).withColumn("status", F.when(F.coalesce(reliable, F.lit(False)), "PASS").otherwise("REQUIRES_MANUAL_ALIGNMENT"))


def geo_only_metrics(pixels: DataFrame, pairs: DataFrame, cfg: dict = REGISTRATION) -> DataFrame:
    """Acceptance without visual refinement: score = min(geographic overlap, jointly valid share).

    ``pixels``: pair_id, valid; ``pairs``: pair_id, geographic_overlap.
    """
    share = pixels.groupBy("pair_id").agg((F.count_if("valid") / F.count("*")).alias("overlap_ratio"))
    wide = pairs.join(share, "pair_id").withColumn("registration_score", F.least("geographic_overlap", "overlap_ratio"))
    good = F.col("registration_score") >= cfg["min_score"]
    return wide.withColumn("status", F.when(good, "PASS_WITH_WARNING").otherwise("REQUIRES_MANUAL_ALIGNMENT")).withColumn(
        "warnings", F.when(good, F.array(F.lit("VISUAL_REFINEMENT_SKIPPED"))).otherwise(
            F.array(F.lit("VISUAL_REFINEMENT_SKIPPED"), F.lit("LOW_REGISTRATION_QUALITY"))))
