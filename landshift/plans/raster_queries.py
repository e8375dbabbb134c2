"""Registered queries on pixels: morphology, components, differences, footprints, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.functions.scalars import round6
from landshift.operators import change as D, raster as R
from landshift.plans import oracle as O
from landshift.plans.risk_queries import flag
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


LUMA = "((9798 * {p}b1 + 19235 * {p}b2 + 3735 * {p}b3 + 16384) >> 15)"


@query("grayscale", O.sql(f"SELECT raster_id, r AS \"row\", c AS col, {LUMA.replace('{p}', '')} AS gray FROM pixels", "pixels"))
def grayscale(spark: SparkSession, root: str) -> DataFrame:
    return R.grayscale(B.pixels(spark, root), ["b1", "b2", "b3"]).select("raster_id", "row", "col", "gray")


def _square(fn: str, src: str, radius: int) -> str:
    """Square neighbourhood aggregate by a self join on coordinates."""
    return f"""SELECT a.raster_id, a.r, a.c, {fn}(b.v) AS v FROM {src} a JOIN {src} b ON b.raster_id = a.raster_id
        AND b.r BETWEEN a.r - {radius} AND a.r + {radius} AND b.c BETWEEN a.c - {radius} AND a.c + {radius}
        GROUP BY 1, 2, 3"""


@query("open_close", O.sql(
    "SELECT raster_id, r AS \"row\", c AS col, v FROM m4", "pixels",
    extra={"m0": "SELECT raster_id, r, c, CASE WHEN b1 >= 110 THEN 1 ELSE 0 END AS v FROM pixels",
           "m1": _square("min", "m0", 1), "m2": _square("max", "m1", 1),
           "m3": _square("max", "m2", 1), "m4": _square("min", "m3", 1)}))
def open_close(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).select("raster_id", "row", "col", (F.col("b1") >= 110).cast("int").alias("v"))
    return R.open_close(px, "v", 3)


@query("dilate_erode", O.sql(
    """SELECT d.raster_id, d.r AS "row", d.c AS col, d.v AS wide, e.v AS narrow FROM d JOIN e
       ON e.raster_id = d.raster_id AND e.r = d.r AND e.c = d.c""", "pixels",
    extra={"m0": "SELECT raster_id, r, c, mask AS v FROM pixels",
           "d": _square("max", "m0", 1), "e": _square("min", "m0", 1)}))
def dilate_erode(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).select("raster_id", "row", "col", "mask")
    return R.erode(R.dilate(px, "mask", 1, out="wide"), "mask", 1, out="narrow").drop("mask")


def component_steps(src: str, key: str, diagonal: bool = True, prefix: str = "") -> dict[str, str]:
    """Recursive twin of the component pass over ``src`` (key, r, c); ``cell`` numbers a pixel."""
    near = "abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1" if diagonal else "abs(b.r - a.r) + abs(b.c - a.c) = 1"
    cols = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"b.{k} = a.{k}" for k in cols)
    ks = ", ".join(f"a.{k}" for k in cols)
    return {
        f"{prefix}touch": f"""SELECT {ks}, a.r * 4294967296 + a.c AS u, b.r * 4294967296 + b.c AS w FROM {src} a JOIN {src} b
            ON {on} AND {near}""",
        f"{prefix}flood": f"""SELECT {', '.join(cols)}, r * 4294967296 + c AS v, r * 4294967296 + c AS w FROM {src}
            UNION SELECT {', '.join('a.' + k for k in cols)}, a.v, b.w FROM {prefix}flood a JOIN {prefix}touch b
            ON {on} AND b.u = a.w""",
        f"{prefix}comp": f"SELECT {', '.join(cols)}, v AS cell, min(w) AS component FROM {prefix}flood GROUP BY ALL",
    }


@query("pixel_components", O.sql(
    "SELECT raster_id, component, count(*) AS pixels FROM comp GROUP BY 1, 2", "pixels",
    extra={"fg": "SELECT raster_id, r, c FROM pixels WHERE mask = 1", **component_steps("fg", "raster_id")}))
def pixel_components(spark: SparkSession, root: str) -> DataFrame:
    fg = B.pixels(spark, root).where("mask = 1").select("raster_id", "row", "col")
    return R.pixel_components(fg).groupBy("raster_id", "component").agg(F.count("*").alias("pixels"))


@query("small_regions_dropped", O.sql(
    """SELECT raster_id, count(*) AS kept FROM comp JOIN (SELECT raster_id AS i, component AS k FROM comp GROUP BY 1, 2
       HAVING count(*) >= 4) ON i = raster_id AND k = component GROUP BY 1""", "pixels",
    extra={"fg": "SELECT raster_id, r, c FROM pixels WHERE mask = 1",
           **component_steps("fg", "raster_id", diagonal=False)}))
def small_regions_dropped(spark: SparkSession, root: str) -> DataFrame:
    fg = B.pixels(spark, root).where("mask = 1").select("raster_id", "row", "col")
    kept = R.drop_small(R.pixel_components(fg, connectivity=4), 4)
    return kept.groupBy("raster_id").agg(F.count("*").alias("kept"))


# ---------------------------------------------------------------- differences

USABLE = "SELECT * FROM pairs WHERE transform_plausible AND overlap_ratio > 0 AND score >= 0.25e0"
_GO, _GN = "((ob1 + ob2 + ob3) / 3e0 / 255e0)", "((nb1 + nb2 + nb3) / 3e0 / 255e0)"
_LIMIT = "least(1e0, 0.15e0 + 0.1e0 * (1 - u.score))"


@query("pixel_difference", O.sql(
    f"""SELECT x.pair_id, x.r AS "row", x.c AS col, {O.r6(f'abs({_GN} - {_GO})')} AS difference,
        CAST(abs({_GN} - {_GO}) >= {_LIMIT} AS INTEGER) AS above
        FROM pair_pixels x JOIN usable u ON u.pair_id = x.pair_id""", "pair_pixels", "pairs", extra={"usable": USABLE}))
def pixel_difference(spark: SparkSession, root: str) -> DataFrame:
    usable = D.usable_pairs(B.pairs(spark, root), 0.25).select("pair_id", "score")
    px = D.difference_score(B.pair_pixels(spark, root).join(usable, "pair_id"))
    limit = F.least(F.lit(1.0), 0.15 + 0.1 * (1 - F.col("score")))
    return px.select("pair_id", "row", "col", round6(F.col("difference")).alias("difference"),
                     flag(F.col("difference") >= limit).alias("above"))


def _mirror(i: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END"


def _gauss_steps() -> dict[str, str]:
    w0, w1, w2 = (repr(w) + "e0" for w in R.gaussian_weights())
    taps = f"(SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([{w2}, {w1}, {w0}, {w1}, {w2}]) AS w) t"
    cols = ("o", "n", "oo", "nn", "xn")
    sums = ", ".join(f"sum(w * b.{c}) AS {c}" for c in cols)
    return {
        "g0": f"SELECT pair_id, r, c, {_GO} AS o, {_GN} AS n, {_GO} * {_GO} AS oo, {_GN} * {_GN} AS nn, {_GO} * {_GN} AS xn FROM pair_pixels",
        "g1": f"SELECT a.pair_id, a.r, a.c, {sums} FROM g0 a, {taps} JOIN g0 b ON b.pair_id = a.pair_id AND b.r = a.r AND b.c = {_mirror('(a.c + t.d)')} GROUP BY 1, 2, 3",
        "g2": f"SELECT a.pair_id, a.r, a.c, {sums} FROM g1 a, {taps} JOIN g1 b ON b.pair_id = a.pair_id AND b.c = a.c AND b.r = {_mirror('(a.r + t.d)')} GROUP BY 1, 2, 3",
        "ssim": """SELECT pair_id, r, c, greatest(0e0, least(1e0, (1 - ((2 * o * n + 0.0001e0) * (2 * (xn - o * n) + 0.0009e0))
            / ((o * o + n * n + 0.0001e0) * ((oo - o * o) + (nn - n * n) + 0.0009e0))) / 2)) AS d FROM g2""",
    }


@query("structural_difference", O.sql(
    'SELECT pair_id, r AS "row", c AS col, round(d, 5) AS difference FROM ssim', "pair_pixels", extra=_gauss_steps()))
def structural_difference(spark: SparkSession, root: str) -> DataFrame:
    px = D.difference_score(B.pair_pixels(spark, root), "structural")
    return px.select("pair_id", "row", "col", F.round("difference", 5).alias("difference"))


_GATE = """CASE WHEN NOT transform_plausible OR overlap_ratio <= 0 THEN 'REGISTRATION_INVALID' WHEN score < 0.25e0 THEN 'REGISTRATION_TOO_LOW' ELSE '' END"""


def difference_steps(scored: str) -> dict[str, str]:
    """From ``scored`` (pair_id, r, c, d, lim) to the cells that stay after opening, closing and dropping."""
    return {
        "scored": scored,
        "m0": "SELECT pair_id AS raster_id, r, c, CASE WHEN d >= lim THEN 1 ELSE 0 END AS v FROM scored",
        "m1": _square("min", "m0", 1), "m2": _square("max", "m1", 1),
        "m3": _square("max", "m2", 1), "m4": _square("min", "m3", 1),
        "dfg": "SELECT raster_id, r, c FROM m4 WHERE v = 1", **component_steps("dfg", "raster_id", prefix="d"),
        "dkept": """SELECT * FROM dcomp WHERE (raster_id, component) IN (SELECT (raster_id, component) FROM dcomp
          GROUP BY raster_id, component HAVING count(*) >= 8)""",
    }


PIXEL_SCORED = f"SELECT x.pair_id, r, c, abs({_GN} - {_GO}) AS d, {_LIMIT} AS lim FROM pair_pixels x JOIN usable u ON u.pair_id = x.pair_id"
_STRUCTURE_SCORED = f"SELECT s.pair_id, r, c, d, {_LIMIT} AS lim FROM ssim s JOIN usable u ON u.pair_id = s.pair_id"


def _difference_sql(score: str, more: str = "") -> str:
    return f"""SELECT p.pair_id, {_GATE} AS error_code, CASE WHEN a.pair_id IS NOT NULL THEN CAST(coalesce(k.n, 0) AS BIGINT) END AS changed_pixels,
        {score} AS model_score{more}
        FROM pairs p LEFT JOIN (SELECT pair_id, avg(d) AS mean_all FROM scored GROUP BY 1) a ON a.pair_id = p.pair_id
        LEFT JOIN (SELECT s.pair_id, count(*) AS n, avg(d) AS mean_in FROM scored s JOIN dkept k ON k.raster_id = s.pair_id
          AND k.cell = s.r * 4294967296 + s.c GROUP BY 1) k ON k.pair_id = p.pair_id"""


@query("image_difference", O.sql(
    _difference_sql(O.r6("coalesce(k.mean_in, 1 - a.mean_all)"), ", CASE WHEN a.pair_id IS NOT NULL THEN CAST(p.score < 0.55e0 AS INTEGER) END AS reduced"),
    "pair_pixels", "pairs", extra={"usable": USABLE, **difference_steps(PIXEL_SCORED)}))
def image_difference(spark: SparkSession, root: str) -> DataFrame:
    _labels, result = D.image_difference(B.pair_pixels(spark, root), B.pairs(spark, root))
    return result.select("pair_id", F.coalesce("error_code", F.lit("")).alias("error_code"), "changed_pixels",
                         round6(F.col("model_score")).alias("model_score"), flag(F.size("warnings") > 0).alias("reduced"))


@query("structural_change", O.sql(
    _difference_sql("round(coalesce(k.mean_in, 1 - a.mean_all), 5)"), "pair_pixels", "pairs",
    extra={"usable": USABLE, **_gauss_steps(), **difference_steps(_STRUCTURE_SCORED)}))
def structural_change(spark: SparkSession, root: str) -> DataFrame:
    _labels, result = D.image_difference(B.pair_pixels(spark, root), B.pairs(spark, root), "structural")
    return result.select("pair_id", F.coalesce("error_code", F.lit("")).alias("error_code"), "changed_pixels",
                         F.round("model_score", 5).alias("model_score"))


MASK_STEPS = {
    "usable": USABLE,
    "cells": """SELECT x.pair_id, r, c, CASE WHEN nm = 1 AND om = 0 THEN 1 WHEN om = 1 AND nm = 0 THEN 2 ELSE 0 END AS kind,
        om = 1 AND nm = 1 AS common FROM pair_pixels x WHERE pair_id IN (SELECT pair_id FROM usable)""",
    "fg": "SELECT pair_id, kind, r, c FROM cells WHERE kind > 0",
    **component_steps("fg", "pair_id, kind"),
    "big": "SELECT pair_id, kind, component FROM comp GROUP BY 1, 2, 3 HAVING count(*) >= 4",
    "kept": "SELECT comp.* FROM comp JOIN big USING (pair_id, kind, component)",
    "near": """SELECT DISTINCT f.pair_id, f.kind, f.r * 4294967296 + f.c AS cell FROM fg f JOIN cells x ON x.pair_id = f.pair_id
        AND x.common AND abs(x.r - f.r) <= 1 AND abs(x.c - f.c) <= 1""",
    "touching": "SELECT DISTINCT k.pair_id, k.kind, k.component FROM kept k JOIN near USING (pair_id, kind, cell)",
    "labelled": """SELECT k.pair_id, k.cell, k.component, k.kind, CASE WHEN k.kind = 1 THEN CASE WHEN t.component IS NULL THEN 1 ELSE 3 END
        ELSE CASE WHEN t.component IS NULL THEN 2 ELSE 4 END END AS label
        FROM kept k LEFT JOIN touching t ON t.pair_id = k.pair_id AND t.kind = k.kind AND t.component = k.component""",
}


@query("mask_difference", O.sql(
    'SELECT pair_id, CAST(cell // 4294967296 AS INTEGER) AS "row", CAST(cell % 4294967296 AS INTEGER) AS col, label FROM labelled',
    "pair_pixels", "pairs", extra=MASK_STEPS))
def mask_difference(spark: SparkSession, root: str) -> DataFrame:
    return D.mask_difference(B.pair_pixels(spark, root), B.pairs(spark, root)).select("pair_id", "row", "col", "label")


@query("changed_area", O.sql(
    f"""SELECT p.pair_id, {_GATE} AS error_code, v.* EXCLUDE (pair_id) FROM pairs p LEFT JOIN (
       SELECT u.pair_id, coalesce(a, 0) AS added_pixels, coalesce(d, 0) AS removed_pixels, k AS common_pixels,
       coalesce(a, 0) * 4e0 AS added_area, coalesce(d, 0) * 4e0 AS removed_area FROM usable u
       JOIN (SELECT pair_id, count(*) FILTER (common) AS k FROM cells GROUP BY 1) n ON n.pair_id = u.pair_id
       LEFT JOIN (SELECT pair_id, count(*) FILTER (kind = 1) AS a, count(*) FILTER (kind = 2) AS d FROM labelled GROUP BY 1) l
         ON l.pair_id = u.pair_id) v ON v.pair_id = p.pair_id""", "pair_pixels", "pairs", extra=MASK_STEPS))
def changed_area(spark: SparkSession, root: str) -> DataFrame:
    px, pairs = B.pair_pixels(spark, root), B.pairs(spark, root)
    return D.changed_area(D.mask_difference(px, pairs), px, pairs).withColumn("error_code", F.coalesce("error_code", F.lit("")))


# ---------------------------------------------------------------- footprints

FOOTPRINT_STEPS = {
    "fg": "SELECT raster_id, r, c FROM pixels WHERE mask = 1",
    "bg": "SELECT raster_id, r, c FROM pixels WHERE mask = 0",
    **component_steps("bg", "raster_id", diagonal=False, prefix="b"),
    "opened": """SELECT DISTINCT raster_id, component FROM bcomp WHERE cell // 4294967296 IN (0, 7) OR cell % 4294967296 IN (0, 7)""",
    "outside": "SELECT raster_id, cell FROM bcomp JOIN opened USING (raster_id, component)",
    "solid": """SELECT raster_id, r, c FROM pixels p WHERE raster_id IN (SELECT raster_id FROM fg) AND NOT EXISTS
        (SELECT 1 FROM outside o WHERE o.raster_id = p.raster_id AND o.cell = p.r * 4294967296 + p.c)""",
    **component_steps("solid", "raster_id", prefix="f"),
    "quads": """SELECT raster_id, component, qr, qc, count(*) AS n FROM (SELECT raster_id, component,
        cell // 4294967296 - a AS qr, cell % 4294967296 - b AS qc FROM fcomp, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) q)
        GROUP BY ALL""",
    "outline": "SELECT raster_id, component, sum(CASE n WHEN 4 THEN 1e0 WHEN 3 THEN 0.5e0 ELSE 0e0 END) AS area FROM quads GROUP BY 1, 2",
}


def _extents(spark: SparkSession, root: str) -> DataFrame:
    return B.raster_meta(spark, root).select("raster_id", "width", "height", "transform", F.lit(1.0).alias("factor"))


@query("component_footprints", O.sql(
    f"""SELECT f.raster_id, f.component, count(*) AS filled_pixels, {O.r6('any_value(o.area)')} AS outline_area,
        {O.r6('any_value(o.area) * 4')} AS area_m2,
        {O.r6('min(2e0 * (cell % 4294967296 + 0.5e0)) + any_value(rx)')} AS min_x,
        {O.r6('200e0 - 2e0 * (min(cell // 4294967296) + 0.5e0)')} AS max_y
        FROM fcomp f JOIN outline o ON o.raster_id = f.raster_id AND o.component = f.component AND o.area >= 2
        JOIN raster_meta m ON m.raster_id = f.raster_id GROUP BY 1, 2""",
    "pixels", "raster_meta", extra=FOOTPRINT_STEPS))
def component_footprints(spark: SparkSession, root: str) -> DataFrame:
    fg = B.pixels(spark, root).where("mask = 1").select("raster_id", "row", "col")
    out = R.component_footprints(fg, _extents(spark, root), minimum_area=2.0)
    return out.select("raster_id", "component", "filled_pixels", round6(F.col("outline_area")).alias("outline_area"),
                      round6(F.col("area_m2")).alias("area_m2"), round6(F.col("box.min_x")).alias("min_x"),
                      round6(F.col("box.max_y")).alias("max_y"))


# ---------------------------------------------------------------- inference and confidence

WEIGHTS, BIAS = [1.5, -0.75, 0.5, 2.0], -1.25
SEG = {"weights": [1.0, -0.5, 0.25], "bias": 0.125, "mean": [0.5, 0.45, 0.4], "std": [0.25, 0.3, 0.2]}


def _seg_logit(p: str) -> str:
    terms = [f"({p}b{i + 1} / 255e0 - {m}e0) / {s}e0 * {w}e0" for i, (w, m, s) in enumerate(zip(SEG["weights"], SEG["mean"], SEG["std"]))]
    return "(" + " + ".join(terms) + f" + {SEG['bias']}e0)"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(-30e0, least(30e0, {x})))))"


@query("segment_pixels", O.sql(
    f"""SELECT raster_id, r AS "row", c AS col, {O.r6(sigmoid(_seg_logit('')))} AS probability,
        CAST({sigmoid(_seg_logit(''))} >= 0.5e0 AS INTEGER) AS predicted FROM pixels""", "pixels"))
def segment_pixels(spark: SparkSession, root: str) -> DataFrame:
    px = D.segment(B.pixels(spark, root), SEG["weights"], SEG["bias"], SEG["mean"], SEG["std"], ["b1", "b2", "b3"])
    return px.select("raster_id", "row", "col", round6(F.col("probability")).alias("probability"), "predicted")


_SIAM = " + ".join([f"abs(nb{i} / 255e0 - ob{i} / 255e0) * ({w}e0)" for i, w in zip((1, 2, 3), WEIGHTS)]
                   + [f"abs(nm - om) * ({WEIGHTS[3]}e0)", f"({BIAS}e0)"])


@query("siamese_labels", O.sql(
    f"""SELECT pair_id, r AS "row", c AS col, {O.r6(sigmoid(_SIAM))} AS probability,
        CASE WHEN {sigmoid(_SIAM)} >= 0.5e0 THEN 5 ELSE 0 END AS label FROM pair_pixels
        WHERE pair_id IN (SELECT pair_id FROM usable)""", "pair_pixels", "pairs", extra={"usable": USABLE}))
def siamese_labels(spark: SparkSession, root: str) -> DataFrame:
    px = D.siamese(B.pair_pixels(spark, root), B.pairs(spark, root), WEIGHTS, BIAS)
    return px.select("pair_id", "row", "col", round6(F.col("probability")).alias("probability"), "label")


@query("change_confidence", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS VARCHAR) AS day,
    {O.r6('''greatest(0e0, least(1e0, least(1e0, abs(l_discount) * 10) * (0.2e0 + 0.8e0 * (0.5e0 + abs(l_tax) * 5))
      * greatest(0e0, 1 - (l_linenumber % 4) * 0.08e0) * CASE WHEN l_partkey % 90 = 0 THEN 1e0 WHEN l_partkey % 90 < 8 THEN 0.35e0
        ELSE least(1e0, 0.6e0 + 0.4e0 * (l_partkey % 90 - 8) / 56) END * (0.5e0 + 0.5e0 * (l_quantity / 50))))''')} AS confidence
    FROM lineitem""")
def change_confidence(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    li = B.table(spark, root, "lineitem")
    value = D.change_confidence(
        F.least(F.lit(1.0), F.abs(c("l_discount")) * 10), 0.5 + F.abs(c("l_tax")) * 5, c("l_linenumber") % 4,
        c("l_partkey") % 90, c("l_quantity") / 50)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("day"), round6(value).alias("confidence"))
