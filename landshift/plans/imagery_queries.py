"""Registered queries on raster quality, registration, evidence and dataset curation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.functions import constants as C
from landshift.functions.scalars import round6
from landshift.operators import curate as U, quality as Q, raster as R, registration as M, spatial as S
from landshift.plans import oracle as O
from landshift.plans.evidence import pair_evidence as evidence_plan
from landshift.plans.raster_queries import FOOTPRINT_STEPS, LUMA, MASK_STEPS, SEG, _mirror, _seg_logit, sigmoid
from landshift.plans.risk_queries import flag, uuid_sql
from landshift.sources import bindings as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


CFG = {**C.QUALITY, "min_side": 8, "valid": 0.955, "blur": 10000.0, "dark": 60, "bright": 200, "exposure": 0.02}

QUALITY_STEPS = {
    "gr": f"SELECT raster_id, r, c, valid, {LUMA.replace('{p}', '')} AS g FROM pixels",
    "lap": f"""SELECT a.raster_id, a.valid, a.g, l.g + k.g + u.g + d.g - 4 * a.g AS v FROM gr a
        JOIN gr l ON l.raster_id = a.raster_id AND l.r = a.r AND l.c = {_mirror('(a.c - 1)')}
        JOIN gr k ON k.raster_id = a.raster_id AND k.r = a.r AND k.c = {_mirror('(a.c + 1)')}
        JOIN gr u ON u.raster_id = a.raster_id AND u.c = a.c AND u.r = {_mirror('(a.r - 1)')}
        JOIN gr d ON d.raster_id = a.raster_id AND d.c = a.c AND d.r = {_mirror('(a.r + 1)')}""",
    "metric": """SELECT raster_id, var_pop(v) FILTER (valid) AS blur, count(*) FILTER (valid AND g <= 12) * 1e0 / count(*) FILTER (valid) AS dark,
        count(*) FILTER (valid AND g >= 243) * 1e0 / count(*) FILTER (valid) AS bright, count(*) FILTER (valid) * 1e0 / count(*) AS ok
        FROM lap GROUP BY 1""",
    "issued": """SELECT m.*, concat_ws('|', CASE WHEN band_count = 2 THEN 'INCOMPATIBLE_BANDS' END,
        CASE WHEN band_count >= 3 AND wrong_order THEN 'INCOMPATIBLE_CHANNEL_ORDER' END,
        CASE WHEN ok < 0.955e0 THEN 'LOW_VALID_PIXEL_RATIO' END, CASE WHEN blur < 10000 THEN 'EXCESSIVE_BLUR' END,
        CASE WHEN dark >= 0.02e0 THEN 'EXTREME_DARKNESS' END, CASE WHEN bright >= 0.02e0 THEN 'EXTREME_OVEREXPOSURE' END) AS issues
        FROM metric m JOIN raster_meta USING (raster_id)""",
    "judged": """SELECT *, CASE WHEN issues LIKE '%INCOMPATIBLE%' OR issues LIKE '%LOW_VALID%' OR issues LIKE '%BLUR%' THEN 'REJECTED'
        WHEN issues <> '' THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS status FROM issued""",
}


def _quality(spark: SparkSession, root: str) -> DataFrame:
    gray = R.grayscale(B.pixels(spark, root), ["b1", "b2", "b3"])
    return Q.raster_quality(Q.raster_metrics(gray), B.raster_meta(spark, root), CFG)


@query("raster_quality", O.sql(
    f"""SELECT raster_id, {O.r2('blur')} AS blur_variance, {O.r6('dark')} AS dark_ratio, {O.r6('bright')} AS bright_ratio,
        {O.r6('ok')} AS valid_ratio, issues, status FROM judged""", "pixels", "raster_meta", extra=QUALITY_STEPS))
def raster_quality(spark: SparkSession, root: str) -> DataFrame:
    from landshift.functions.scalars import round2

    return _quality(spark, root).select(
        "raster_id", round2(F.col("blur_variance")).alias("blur_variance"), round6(F.col("dark_ratio")).alias("dark_ratio"),
        round6(F.col("bright_ratio")).alias("bright_ratio"), round6(F.col("valid_ratio")).alias("valid_ratio"),
        F.array_join("issues", "|").alias("issues"), "status")


def _pair_meta(spark: SparkSession, root: str) -> DataFrame:
    """Consecutive assets as old and new image with extents, resolutions and band counts."""
    a = B.assets(spark, root)

    def side(p: str, shift: int) -> DataFrame:
        return a.select((F.col("ordinal") + shift).alias("pair_id"), F.col("box").alias(f"{p}_box"),
                        F.col("resolution_m").alias(f"{p}_res"), F.col("band_count").alias(f"{p}_bands"))

    return side("old", 0).join(side("new", -10), "pair_id")


_PAIR_META = """SELECT o.ordinal AS pair_id, o.ax0 AS ox0, o.ay0 AS oy0, o.ax1 AS ox1, o.ay1 AS oy1, n.ax0 AS nx0, n.ay0 AS ny0,
    n.ax1 AS nx1, n.ay1 AS ny1, o.resolution_m AS ores, n.resolution_m AS nres, o.band_count AS ob, n.band_count AS nb
    FROM assets o JOIN assets n ON n.ordinal = o.ordinal + 10"""
_PQ = {"meta": _PAIR_META,
       "pq": f"""SELECT *, {O.inter('o', 'n')} / least({O.inter('o')}, {O.inter('n')}) AS ov, greatest(ores, nres) / least(ores, nres) AS rr FROM meta"""}


@query("pair_quality", O.sql(
    f"""SELECT pair_id, {O.r6('ov')} AS geographic_overlap, {O.r6('rr')} AS resolution_ratio,
        concat_ws('|', CASE WHEN ov < 0.2e0 THEN 'INSUFFICIENT_GEOGRAPHIC_OVERLAP' END, CASE WHEN rr > 2 THEN 'LARGE_RESOLUTION_MISMATCH' END,
          CASE WHEN ob <> nb THEN 'INCOMPATIBLE_BANDS' END) AS issues,
        CASE WHEN ov < 0.2e0 OR ob <> nb THEN 'REJECTED' WHEN rr > 2 THEN 'REQUIRES_MANUAL_ALIGNMENT' ELSE 'PASS' END AS status FROM pq""",
    "assets", extra=_PQ))
def pair_quality(spark: SparkSession, root: str) -> DataFrame:
    out = Q.pair_quality(_pair_meta(spark, root), {**C.QUALITY, "resolution_ratio": 2.0})
    return out.select("pair_id", round6(F.col("geographic_overlap")).alias("geographic_overlap"),
                      round6(F.col("resolution_ratio")).alias("resolution_ratio"),
                      F.array_join("pair_issues", "|").alias("issues"), F.col("pair_status").alias("status"))


@query("common_grid", O.sql(
    f"""SELECT pair_id, greatest(ores, nres) AS resolution, CAST(floor((least(ox1, nx1) - greatest(ox0, nx0)) / greatest(ores, nres)) AS BIGINT) AS grid_width,
        CAST(floor((least(oy1, ny1) - greatest(oy0, ny0)) / greatest(ores, nres)) AS BIGINT) AS grid_height, greatest(ox0, nx0) AS "left",
        CASE WHEN least(ox1, nx1) - greatest(ox0, nx0) < greatest(ores, nres) THEN 'INSUFFICIENT_OVERLAP' ELSE '' END AS error_code FROM meta""",
    "assets", extra={"meta": _PAIR_META}))
def common_grid(spark: SparkSession, root: str) -> DataFrame:
    return S.common_grid(_pair_meta(spark, root)).select(
        "pair_id", "resolution", "grid_width", "grid_height", "left", F.coalesce("error_code", F.lit("")).alias("error_code"))


def _grids(spark: SparkSession, root: str) -> DataFrame:
    """A 5x5 target grid per raster, coarser than the raster and shifted against it."""
    return B.raster_meta(spark, root).select(
        F.col("raster_id").alias("grid_id"), "raster_id", (F.col("box")["min_x"] + 1.0).alias("left"),
        (F.col("box")["max_y"] - 0.5).alias("top"), F.lit(3.0).alias("resolution"), F.lit(5).cast("long").alias("grid_width"),
        F.lit(5).cast("long").alias("grid_height"), F.col("box")["min_x"].alias("src_left"), F.col("box")["max_y"].alias("src_top"),
        F.lit(2.0).alias("src_res"))


_TARGET = """SELECT raster_id, tr, tc, (1.0e0 + (tc + 0.5e0) * 3 ) / 2e0 AS sx, (0.5e0 + (tr + 0.5e0) * 3) / 2e0 AS sy
    FROM raster_meta, (SELECT unnest(generate_series(0, 4)) AS tr) a, (SELECT unnest(generate_series(0, 4)) AS tc) b"""


@query("resample_nearest", O.sql(
    """SELECT t.raster_id, tr AS "row", tc AS col, coalesce(p.b1, -1) * 1e0 AS value, CAST(coalesce(p.valid, false) AS INTEGER) AS valid
       FROM target t LEFT JOIN pixels p ON p.raster_id = t.raster_id AND p.r = floor(t.sy) AND p.c = floor(t.sx)""",
    "pixels", "raster_meta", extra={"target": _TARGET}))
def resample_nearest(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).withColumn("value", F.col("b1"))
    return S.resample(px, _grids(spark, root)).select(
        "raster_id", "row", "col", F.coalesce("value", F.lit(-1.0)).alias("value"), flag("valid").alias("valid"))


@query("resample_bilinear", O.sql(
    f"""SELECT raster_id, tr AS "row", tc AS col, {O.r6('coalesce(sum(w * b1) / nullif(sum(w), 0), -1)')} AS value FROM (
        SELECT t.raster_id, tr, tc, p.b1, CASE WHEN p.valid THEN
          (CASE WHEN dx = 1 THEN sx - 0.5e0 - floor(sx - 0.5e0) ELSE 1 - (sx - 0.5e0 - floor(sx - 0.5e0)) END)
          * (CASE WHEN dy = 1 THEN sy - 0.5e0 - floor(sy - 0.5e0) ELSE 1 - (sy - 0.5e0 - floor(sy - 0.5e0)) END) END AS w
        FROM target t, (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx) k
        LEFT JOIN pixels p ON p.raster_id = t.raster_id AND p.r = floor(t.sy - 0.5e0) + dy AND p.c = floor(t.sx - 0.5e0) + dx)
        GROUP BY 1, 2, 3""", "pixels", "raster_meta", extra={"target": _TARGET}))
def resample_bilinear(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).withColumn("value", F.col("b1"))
    return S.resample(px, _grids(spark, root), "bilinear").select(
        "raster_id", "row", "col", round6(F.coalesce("value", F.lit(-1.0))).alias("value"))


@query("contrast_stretch", O.sql(
    """SELECT p.raster_id, r AS "row", c AS col, CASE WHEN hi > lo THEN CAST(floor(greatest(0e0, least(255e0, (b1 - lo) * (255e0 / (hi - lo)))) + 1e-9) AS INTEGER)
       ELSE 0 END AS stretched FROM pixels p JOIN (SELECT raster_id, quantile_cont(b1, 0.02e0) AS lo, quantile_cont(b1, 0.98e0) AS hi
       FROM pixels WHERE valid GROUP BY 1) q ON q.raster_id = p.raster_id""", "pixels"))
def contrast_stretch(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).withColumn("gray", F.col("b1"))
    return Q.contrast_stretch(px).select("raster_id", "row", "col", "stretched")


_REL = {
    **_PQ,
    "run": """SELECT pair_id, ov, rr, ob, nb, pair_id % 4 = 0 AS dark, pair_id % 11 = 0 AS blurred, pair_id % 7 = 0 AS unsure FROM pq""",
    "decided": """SELECT pair_id, CASE WHEN blurred THEN 'registration_quality' WHEN ov < 0.2e0 THEN 'insufficient_overlap'
        WHEN ob <> nb THEN 'registration_quality' ELSE '' END AS failure,
        concat_ws('|', CASE WHEN dark THEN 'EXTREME_DARKNESS' END, CASE WHEN rr > 2 THEN 'LARGE_RESOLUTION_MISMATCH' END,
          CASE WHEN unsure THEN 'LOW_REGISTRATION_QUALITY' END, CASE WHEN unsure OR rr > 2 THEN 'MANUAL_ALIGNMENT_REQUIRED' END) AS reasons,
        rr > 2 AS coarse, unsure OR rr > 2 AS manual, dark FROM run""",
}


@query("registration_reliability", O.sql(
    """SELECT pair_id, CASE WHEN failure <> '' THEN 'REJECTED' WHEN manual THEN 'REQUIRES_MANUAL_ALIGNMENT' WHEN dark THEN 'PASS_WITH_WARNING'
         ELSE 'PASS' END AS status, CAST(failure = '' AND NOT manual AS INTEGER) AS reliable,
       CASE WHEN failure <> '' THEN 'geospatial_alignment' WHEN NOT manual THEN '' WHEN coarse THEN 'geospatial_alignment'
         ELSE 'visual_refinement' END AS failure_stage,
       CASE failure WHEN 'insufficient_overlap' THEN 'INSUFFICIENT_GEOGRAPHIC_OVERLAP' WHEN 'registration_quality' THEN 'REGISTRATION_INPUT_REJECTED'
         ELSE reasons END AS reason_codes FROM decided""", "assets", extra=_REL))
def registration_reliability(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("pair_id")
    none = F.array().cast("array<string>")
    quality = Q.pair_quality(_pair_meta(spark, root), {**C.QUALITY, "resolution_ratio": 2.0})
    run = quality.select(
        "*", F.when(p % 4 == 0, F.array(F.lit("EXTREME_DARKNESS"))).otherwise(none).alias("old_issues"),
        F.when(p % 11 == 0, F.array(F.lit("EXCESSIVE_BLUR"))).otherwise(none).alias("new_issues"),
        F.when(p % 7 == 0, "REQUIRES_MANUAL_ALIGNMENT").otherwise("PASS").alias("compute_status"),
        F.when(p % 7 == 0, F.array(F.lit("LOW_REGISTRATION_QUALITY"))).otherwise(none).alias("compute_warnings"),
        F.lit(True).alias("visual_refinement_applied"))
    done = Q.reliability(Q.registration_status(run))
    return done.select("pair_id", F.col("decided_status").alias("status"), flag("reliable").alias("reliable"),
                       F.coalesce("failure_stage", F.lit("")).alias("failure_stage"),
                       F.array_join("reason_codes", "|").alias("reason_codes"))


_INGEST_ID = uuid_sql("asset", "municipality_id || ':' || content_sha256")


@query("asset_ingest", O.sql(
    f"""SELECT ordinal, asset_key, CASE WHEN byte_size > 30000 THEN 'TOO_MANY_BYTES' WHEN ordinal % 43 = 0 THEN 'QUALITY_REJECTED'
        WHEN stored_p IS NULL AND ordinal = first_o THEN 'new' WHEN p = coalesce(stored_p, first_p) THEN 'same' ELSE 'conflict' END AS state
        FROM (SELECT a.*, f.first_o, f.first_p, s.p AS stored_p FROM keyed a
          LEFT JOIN (SELECT asset_key, min(ordinal) AS first_o, arg_min(p, ordinal) AS first_p FROM keyed
            WHERE byte_size <= 30000 AND ordinal % 43 <> 0 GROUP BY 1) f ON f.asset_key = a.asset_key
          LEFT JOIN (SELECT asset_key, any_value(p) AS p FROM keyed WHERE ordinal % 8 = 1 GROUP BY 1) s ON s.asset_key = a.asset_key)""",
    "assets", extra={"keyed": f"""SELECT ordinal, byte_size, source || '/' || CAST(resolution_m AS VARCHAR) AS p, {_INGEST_ID} AS asset_key FROM assets"""}))
def asset_ingest(spark: SparkSession, root: str) -> DataFrame:
    a = B.assets(spark, root).select("ordinal", "municipality_id", "content_sha256", "source", "resolution_m", "byte_size")
    incoming = a.withColumn("pixel_count", F.lit(4096)).withColumn(
        "quality_status", F.when(F.col("ordinal") % 43 == 0, "REJECTED").otherwise("PASS"))
    stored = a.where(F.col("ordinal") % 8 == 1).groupBy("municipality_id", "content_sha256").agg(
        F.first("source").alias("source"), F.first("resolution_m").alias("resolution_m"))
    return Q.ingest(incoming, stored, ["source", "resolution_m"], max_bytes=30_000).select("ordinal", "asset_key", "state")


@query("quality_snapshot", O.sql(
    """SELECT (SELECT count(*) FROM judged) AS total_assets, (SELECT count(*) FROM judged WHERE status <> 'PASS') AS low_quality_assets,
       (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0) AS registration_failures,
       (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 1) AS model_checksum_failures,
       (SELECT count(*) FROM orders WHERE o_totalprice / 5000 >= 50) AS high_risk_cases""",
    "pixels", "raster_meta", extra=QUALITY_STEPS))
def quality_snapshot(spark: SparkSession, root: str) -> DataFrame:
    failures = B.table(spark, root, "events").where("event_type = 'error'").select(
        F.when(F.col("event_id") % 2 == 0, "REGISTRATION_FAILED").otherwise("MODEL_CHECKSUM_MISMATCH").alias("failure_code"))
    cases = B.table(spark, root, "orders").select((F.col("o_totalprice") / 5000).alias("score"))
    return Q.quality_snapshot(_quality(spark, root).select("status"), failures, cases)


# ---------------------------------------------------------------- registration

def _features(spark: SparkSession, root: str) -> DataFrame:
    """Sign bits of a vector as descriptor; fifty vectors make an image, two images a pair."""
    e = F.col("embedding")
    bit = lambda i: F.when(F.get(e, i) > 0, 1).otherwise(0)
    digits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(
        F.lit("0123456789abcdef"), bit(i * 4) * 8 + bit(i * 4 + 1) * 4 + bit(i * 4 + 2) * 2 + bit(i * 4 + 3) + 1, F.lit(1)))
    image = F.floor(F.col("vec_id") / 50)
    return B.table(spark, root, "embeddings").select(
        F.floor(image / 2).alias("pair_id"), (image % 2).alias("side"), F.col("vec_id").alias("feature_id"),
        F.unhex(F.array_join(digits, "")).alias("descriptor"))


@query("descriptor_matches", """
    WITH f AS (SELECT vec_id, CAST(floor(vec_id / 100.0) AS BIGINT) AS pair_id, CAST(floor(vec_id / 50.0) AS BIGINT) % 2 AS side, embedding FROM embeddings),
    d AS (SELECT l.pair_id, l.vec_id AS left_id, r.vec_id AS right_id, CAST(list_sum(list_transform(generate_series(1, 64),
        lambda i: CASE WHEN (l.embedding[i] > 0) <> (r.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM f l JOIN f r ON r.pair_id = l.pair_id AND l.side = 1 AND r.side = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS k,
      lead(distance) OVER (PARTITION BY left_id ORDER BY distance, right_id) AS second_distance FROM d)
    SELECT pair_id, left_id, right_id, distance, second_distance FROM k WHERE k = 1 AND distance < 0.9e0 * second_distance""")
def descriptor_matches(spark: SparkSession, root: str) -> DataFrame:
    f = _features(spark, root)
    return M.ratio_test_matches(f.where("side = 1").drop("side"), f.where("side = 0").drop("side"), 0.9)


def _points(spark: SparkSession, root: str) -> DataFrame:
    """Control points per supplier: a known affine with small offsets."""
    c = F.col
    return B.table(spark, root, "lineitem").select(
        c("l_suppkey").alias("pair_id"), (c("l_quantity") * 2).alias("after_x"), (c("l_partkey") % 97).cast("double").alias("after_y"),
        (c("l_quantity") * 2 * 1.01 + (c("l_linenumber") - 4) * 0.25 + 3).alias("before_x"),
        (c("l_partkey") % 97 * 0.99 + (c("l_orderkey") % 5) * 0.5 - 1 + F.when(c("l_orderkey") % 13 == 0, 9).otherwise(0)).alias("before_y"))


_AFFINE = {
    "pts": """SELECT l_suppkey AS pair_id, l_quantity * 2 AS x, (l_partkey % 97) * 1e0 AS y, l_quantity * 2 * 1.01e0 + (l_linenumber - 4) * 0.25e0 + 3 AS u,
        l_partkey % 97 * 0.99e0 + (l_orderkey % 5) * 0.5e0 - 1 + CASE WHEN l_orderkey % 13 = 0 THEN 9 ELSE 0 END AS v FROM lineitem""",
    "fit": """SELECT pair_id, count(*) AS n,
        (covar_pop(u, x) * var_pop(y) - covar_pop(u, y) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)) AS a,
        (covar_pop(u, y) * var_pop(x) - covar_pop(u, x) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)) AS b,
        (covar_pop(v, x) * var_pop(y) - covar_pop(v, y) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)) AS d,
        (covar_pop(v, y) * var_pop(x) - covar_pop(v, x) * covar_pop(x, y)) / (var_pop(x) * var_pop(y) - pow(covar_pop(x, y), 2)) AS e,
        avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM pts GROUP BY 1""",
    "fitted": "SELECT *, mu - a * mx - b * my AS c, mv - d * mx - e * my AS f FROM fit",
}


def _r4(x: str) -> str:
    return f"round_even(({x}) * 10000e0, 0) / 10000e0 + 0e0"


@query("affine_fit", O.sql(
    "SELECT pair_id, n, " + ", ".join(f"{_r4(k)} AS {k}" for k in "abcdef") + " FROM fitted",
    extra=_AFFINE))
def affine_fit(spark: SparkSession, root: str) -> DataFrame:
    from landshift.functions.scalars import decimals

    return M.fit_affine(_points(spark, root)).select("pair_id", "n", *[(decimals(F.col(k), 4) + 0.0).alias(k) for k in "abcdef"])


@query("registration_metrics", O.sql(
    f"""SELECT pair_id, n AS matches, i AS inlier_count, {_r4('err')} AS reprojection_error,
        {_r4('0.25e0 * least(1e0, i / 8e0) + 0.25e0 * least(1e0, i * 1e0 / n / 0.2e0) + 0.25e0 * greatest(0e0, 1 - err / 4e0) + 0.25e0 * 0.9e0')} AS score,
        CASE WHEN i >= 8 AND i * 1e0 / n >= 0.2e0 AND err <= 4 THEN 'PASS' ELSE 'REQUIRES_MANUAL_ALIGNMENT' END AS status FROM (
        SELECT pair_id, count(*) AS n, count(*) FILTER (d <= 3) AS i, avg(d) FILTER (d <= 3) AS err FROM (
          SELECT p.pair_id, sqrt(pow(a * x + b * y + c - u, 2) + pow(d * x + e * y + f - v, 2)) AS d FROM pts p JOIN fitted t ON t.pair_id = p.pair_id)
        GROUP BY 1)""", extra=_AFFINE))
def registration_metrics(spark: SparkSession, root: str) -> DataFrame:
    from landshift.functions.scalars import decimals

    pts = _points(spark, root)
    fit = M.fit_affine(pts).where("error_code is null").drop("n", "error_code").withColumn("overlap_ratio", F.lit(0.9))
    return M.registration_metrics(pts, fit).select(
        "pair_id", "matches", "inlier_count", (decimals(F.col("reprojection_error"), 4) + 0.0).alias("reprojection_error"),
        (decimals(F.col("registration_score"), 4) + 0.0).alias("score"), "status")


@query("transform_plausibility", """
    SELECT c_custkey, concat_ws('|', CASE WHEN a * e - b * d <= 0 THEN 'REFLECTION' END,
      CASE WHEN greatest(abs(sqrt((t + s) / 2) - 1), abs(sqrt(greatest(0e0, (t - s) / 2)) - 1)) > 0.3e0 THEN 'SCALE' END,
      CASE WHEN abs(degrees(atan2(d, a))) > 15 THEN 'ROTATION' END,
      CASE WHEN sqrt(c * c + f * f) / sqrt(100e0 * 100 + 80e0 * 80) > 0.35e0 THEN 'TRANSLATION' END) AS issues
    FROM (SELECT *, a * a + b * b + d * d + e * e AS t, sqrt(pow(a * a + b * b - d * d - e * e, 2) + 4 * pow(a * d + b * e, 2)) AS s FROM (
      SELECT c_custkey, 1 + (c_custkey % 9 - 4) * 0.11e0 AS a, (c_custkey % 5 - 2) * 0.13e0 AS b, (c_custkey % 13) * 2e0 AS c,
        (c_custkey % 7 - 3) * 0.1e0 AS d, 1 - (c_custkey % 21) * 0.06e0 AS e, (c_custkey % 17) * 3e0 AS f FROM customer))""")
def transform_plausibility(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    t = B.table(spark, root, "customer").select(
        k, (1 + (k % 9 - 4) * 0.11).alias("a"), ((k % 5 - 2) * 0.13).alias("b"), ((k % 13) * 2.0).alias("c"),
        ((k % 7 - 3) * 0.1).alias("d"), (1 - (k % 21) * 0.06).alias("e"), ((k % 17) * 3.0).alias("f"))
    return t.select("c_custkey", F.array_join(M.transform_issues(F.lit(100.0), F.lit(80.0)), "|").alias("issues"))


@query("geo_only_metrics", O.sql(
    f"""SELECT p.pair_id, {O.r6('least(0.97e0, avg(CASE WHEN ov AND nv THEN 1e0 ELSE 0e0 END))')} AS score,
        CASE WHEN least(0.97e0, avg(CASE WHEN ov AND nv THEN 1e0 ELSE 0e0 END)) >= 0.92e0 THEN 'PASS_WITH_WARNING'
          ELSE 'REQUIRES_MANUAL_ALIGNMENT' END AS status FROM pair_pixels p GROUP BY 1""", "pair_pixels"))
def geo_only_metrics(spark: SparkSession, root: str) -> DataFrame:
    px = B.pair_pixels(spark, root).select("pair_id", (F.col("old_valid") & F.col("new_valid")).alias("valid"))
    pairs = B.pairs(spark, root).select("pair_id", F.lit(0.97).alias("geographic_overlap"))
    return M.geo_only_metrics(px, pairs, {**C.REGISTRATION, "min_score": 0.92}).select(
        "pair_id", round6(F.col("registration_score")).alias("score"), "status")


def _pair_extents(spark: SparkSession, root: str) -> DataFrame:
    return B.raster_meta(spark, root).where(F.col("raster_id") % 2 == 0).select(
        F.floor(F.col("raster_id") / 2).alias("pair_id"), "width", "height", "transform", F.lit(1.0).alias("factor"))


def _renamed(steps: dict[str, str], **names: str) -> dict[str, str]:
    """Steps with some of the tables that they read or make under other names."""
    def new(text: str) -> str:
        return re.sub(rf"\b({'|'.join(names)})\b", lambda m: names[m[1]], text)
    return {names.get(k, k): new(v) for k, v in steps.items()}


# Every mask of a pair is a raster of its own: 0 and 1 for the sides, 2 to 5 for the change labels 1 to 4.
_EVIDENCE_STEPS = {
    "segmented": f"""SELECT pair_id, r, c, {sigmoid(_seg_logit('o'))} AS po, {sigmoid(_seg_logit('n'))} AS pn,
        CAST(po >= 0.5e0 AS INTEGER) AS om, CAST(pn >= 0.5e0 AS INTEGER) AS nm FROM pair_pixels""",
    **_renamed(MASK_STEPS, pair_pixels="segmented"),
    "shapes": """SELECT s.pair_id * 8 + k AS raster_id, s.r, s.c, CASE k WHEN 0 THEN om WHEN 1 THEN nm
        ELSE CAST(l.label IS NOT DISTINCT FROM k - 1 AS INTEGER) END AS mask
        FROM segmented s JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) kinds ON true
        LEFT JOIN labelled l ON l.pair_id = s.pair_id AND l.cell = s.r * 4294967296 + s.c""",
    **_renamed(FOOTPRINT_STEPS, pixels="shapes", fg="shape_fg"),
    "found": "SELECT raster_id // 8 AS pair_id, raster_id % 8 AS k, area * 4 AS area FROM outline WHERE area >= 2",
    "wide": """SELECT p.*, s.seg, coalesce(l.n, 0) AS changed, coalesce(f.sides, 0) AS sides, coalesce(f.polygons, 0) AS polygons,
        coalesce(f.area, 0e0) AS area, u.pair_id IS NOT NULL AS registered FROM pairs p
        JOIN (SELECT pair_id, avg(po + pn) / 2 AS seg FROM segmented GROUP BY 1) s ON s.pair_id = p.pair_id
        LEFT JOIN (SELECT pair_id, count(*) AS n FROM labelled GROUP BY 1) l ON l.pair_id = p.pair_id
        LEFT JOIN (SELECT pair_id, count(DISTINCT k) FILTER (k < 2) AS sides, count(*) FILTER (k > 1) AS polygons,
          sum(area) FILTER (k > 1) AS area FROM found GROUP BY 1) f ON f.pair_id = p.pair_id
        LEFT JOIN usable u ON u.pair_id = p.pair_id""",
}


_CONFIDENCE = (
    "greatest(0e0, least(1e0, seg * (0.2e0 + 0.8e0 * score) * greatest(0e0, 1 - warning_count * 0.08e0) * CASE WHEN changed = 0 THEN 1e0 "
    "WHEN changed < 8 THEN 0.35e0 ELSE least(1e0, 0.6e0 + 0.4e0 * (changed - 8) / 56) END * (0.5e0 + 0.5e0 * seg)))")


@query("pair_evidence", O.sql(
    f"""SELECT pair_id, CASE WHEN NOT registered THEN 'REGISTRATION_FAILED' WHEN sides < 2 THEN 'REGISTRATION_QUALITY_TOO_LOW' ELSE '' END AS error_code,
        changed AS changed_pixels, polygons, {O.r6('area')} AS changed_area, {O.r6('seg')} AS segmentation_confidence,
        {O.r6(_CONFIDENCE)} AS change_confidence,
        CASE WHEN pair_id % 8 = 0 THEN 'REQUIRES_MANUAL_ALIGNMENT' WHEN pair_id % 5 = 0 THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS image_status
        FROM wide""", "pair_pixels", "pairs", extra=_EVIDENCE_STEPS))
def pair_evidence(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("pair_id")
    pairs = B.pairs(spark, root).select(
        "*", F.when(p % 5 == 0, "PASS_WITH_WARNING").otherwise("PASS").alias("old_status"),
        F.when(p % 8 == 0, "REQUIRES_MANUAL_ALIGNMENT").otherwise("PASS").alias("new_status"))
    out = evidence_plan(B.pair_pixels(spark, root), pairs, SEG, _pair_extents(spark, root))
    return out.select(
        "pair_id", F.coalesce("error_code", F.lit("")).alias("error_code"), "changed_pixels", "polygons",
        round6(F.col("changed_area")).alias("changed_area"), round6(F.col("segmentation_confidence")).alias("segmentation_confidence"),
        round6(F.col("change_confidence")).alias("change_confidence"), "image_status")


# ---------------------------------------------------------------- curation

_NEAR = {
    "near_tiles": """SELECT a.tile_id AS a, b.tile_id AS b FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id AND (a.region_group = b.region_group
        OR sqrt(pow(greatest(0e0, a.tx0 - b.tx1, b.tx0 - a.tx1), 2) + pow(greatest(0e0, a.ty0 - b.ty1, b.ty0 - a.ty1), 2)) <= 0.5e0)""",
    "reach": """SELECT tile_id AS v, tile_id AS w FROM tiles UNION SELECT reach.v, CASE WHEN e.a = reach.w THEN e.b ELSE e.a END
        FROM reach JOIN near_tiles e ON e.a = reach.w OR e.b = reach.w""",
    "grouped": "SELECT v AS tile_id, min(w) AS group_id FROM reach GROUP BY 1",
}


def _tiles(spark: SparkSession, root: str) -> DataFrame:
    return B.tiles(spark, root).withColumnRenamed("tile_id", "id")


_HEAD = "CAST(('0x' || substr(sha256('17:' || group_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616e0"


@query("geographic_splits", O.sql(
    f"""SELECT tile_id, group_id, CASE WHEN {_HEAD} < 0.7e0 THEN 'train' WHEN {_HEAD} < 0.85e0 THEN 'validation' ELSE 'test' END AS split
        FROM grouped""", "tiles", extra=_NEAR))
def geographic_splits(spark: SparkSession, root: str) -> DataFrame:
    return U.geographic_splits(_tiles(spark, root).drop("split"), 0.5).select(F.col("id").alias("tile_id"), "group_id", "split")


@query("split_leakage", O.sql(
    """SELECT group_id, count(*) AS items, count(DISTINCT split) AS splits FROM grouped JOIN tiles USING (tile_id) GROUP BY 1
       HAVING count(DISTINCT split) > 1""", "tiles", extra=_NEAR))
def split_leakage(spark: SparkSession, root: str) -> DataFrame:
    return U.split_leakage(_tiles(spark, root), 0.5).select("group_id", "items", "splits")


@query("cross_split_duplicates", """SELECT content_sha256, count(*) AS items, count(DISTINCT split) AS splits FROM (
    SELECT sha256(text) AS content_sha256, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM documents)
    GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def cross_split_duplicates(spark: SparkSession, root: str) -> DataFrame:
    docs = B.table(spark, root, "documents").select(
        F.sha2("text", 256).alias("content_sha256"), F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test").alias("split"))
    return U.cross_split_duplicates(docs, "content_sha256")


@query("sample_violations", O.sql(
    """SELECT pair_id, concat_ws('|', CASE WHEN pair_id % 9 = 0 THEN 'DIMENSIONS' END,
       CASE WHEN pair_id % 8 = 3 THEN 'PAIR_HASH_MISMATCH' END, CASE WHEN pair_id % 10 = 0 THEN 'LABEL_REJECTED' END,
       CASE WHEN NOT transform_plausible OR overlap_ratio <= 0 THEN 'REGISTRATION_INVALID' END) AS violations FROM pairs""", "pairs"))
def sample_violations(spark: SparkSession, root: str) -> DataFrame:
    p, px, bands = F.col("pair_id"), B.pair_pixels(spark, root), ["b1", "b2", "b3"]
    named = F.when(p % 8 == 3, F.sha2(p.cast("string"), 256)).otherwise(F.col("pair_sha256")).alias("pair_sha256")
    meta = B.pairs(spark, root).join(U.pair_hash(px, bands), "pair_id").select(
        "pair_id", named, F.lit(8).alias("width"), F.when(p % 9 == 0, 9).otherwise(8).alias("height"),
        F.when(p % 10 == 0, "rejected").otherwise("accepted").alias("label_quality"), "transform_plausible", "overlap_ratio")
    return U.sample_violations(px, meta, bands=bands).select("pair_id", F.array_join("violations", "|").alias("violations"))


@query("dataset_report", O.sql(
    """SELECT 'split' AS kind, split AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS ratio FROM pairs GROUP BY 2
       UNION ALL SELECT 'class', CAST(target AS VARCHAR), count(*), NULL FROM pair_pixels GROUP BY 2
       UNION ALL SELECT 'empty', 'samples', count(*) FILTER (t = 0), NULL FROM (SELECT max(target) AS t FROM pair_pixels GROUP BY pair_id)
       UNION ALL SELECT 'coverage', 'labelled', count(*) FILTER (target <> 0), count(*) FILTER (target <> 0) / CAST(count(*) AS DOUBLE) FROM pair_pixels""",
    "pairs", "pair_pixels"))
def dataset_report(spark: SparkSession, root: str) -> DataFrame:
    return U.dataset_report(B.pair_pixels(spark, root), B.pairs(spark, root))


@query("tile_hashes", O.sql(
    """SELECT raster_id, sha256('8|8|' || string_agg(h, '' ORDER BY r)) AS tile_sha256 FROM (
       SELECT raster_id, r, sha256(string_agg(b1 || ',' || b2 || ',' || b3, ';' ORDER BY c)) AS h FROM pixels GROUP BY 1, 2) GROUP BY 1""", "pixels"))
def tile_hashes(spark: SparkSession, root: str) -> DataFrame:
    return U.tile_hash(B.pixels(spark, root), ["b1", "b2", "b3"])


_PAIR_ROWS = """SELECT pair_id, r, sha256(string_agg(ob1 || ',' || ob2 || ',' || ob3, ';' ORDER BY c)) AS oh,
    sha256(string_agg(nb1 || ',' || nb2 || ',' || nb3, ';' ORDER BY c)) AS nh FROM pair_pixels GROUP BY 1, 2"""


@query("pair_hashes", O.sql(
    f"""SELECT pair_id, sha256(sha256('8|8|' || string_agg(oh, '' ORDER BY r)) || '|' || sha256('8|8|' || string_agg(nh, '' ORDER BY r)))
       AS pair_sha256 FROM ({_PAIR_ROWS}) GROUP BY 1""", "pair_pixels"))
def pair_hashes(spark: SparkSession, root: str) -> DataFrame:
    return U.pair_hash(B.pair_pixels(spark, root), ["b1", "b2", "b3"])


@query("channel_stats", O.sql(
    "SELECT " + ", ".join(f"{O.r6(f'avg({b} / 255e0)')} AS {b}_mean, {O.r6(f'stddev_pop({b} / 255e0)')} AS {b}_std" for b in ("b1", "b2", "b3"))
    + " FROM pixels", "pixels"))
def channel_stats(spark: SparkSession, root: str) -> DataFrame:
    out = U.channel_stats(B.pixels(spark, root), ["b1", "b2", "b3"])
    return out.select(*[round6(F.col(c)).alias(c) for c in out.columns])
