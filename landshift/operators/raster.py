"""Pixel tables: grayscale, windows along rows and columns, morphology, smoothing, components.

A pixel table has key columns (one raster or pair), row, col and values. Windows run inside one
row or one column of one raster, so even the largest raster is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from landshift.functions import boxes as G
from landshift.operators.components import connected_components
from landshift.session import cut_lineage

Key = tuple[str, ...]

#: Columns of a row in which runs are compared with those below.
STRETCH = 64


def along_row(key: Key) -> WindowSpec:
    return Window.partitionBy(*key, "row").orderBy("col")


def along_col(key: Key) -> WindowSpec:
    return Window.partitionBy(*key, "col").orderBy("row")


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with the usual 15-bit fixed-point weights."""
    weighted = r.cast("long") * 9798 + g.cast("long") * 19235 + b.cast("long") * 3735 + 16384
    return F.shiftright(weighted, 15).cast("int")


def grayscale(pixels: DataFrame, bands: list[str], key: Key = ("raster_id",), integer_max: float | None = 255.0) -> DataFrame:
    """Adds ``gray`` (0..255): integers by their type's maximum, floats in 0..1 scaled, NaN as 0."""
    if integer_max is not None:
        level = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(c) * F.lit(255.0 / integer_max)))
        source = pixels
    else:
        clean = [F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c)) for c in bands]
        peak = pixels.groupBy(*key).agg(F.max(F.greatest(*clean) if len(clean) > 1 else clean[0]).alias("_peak"))
        source = pixels.join(peak, list(key))
        scale = F.when(F.col("_peak") <= 1.0, 255.0).otherwise(1.0)
        level = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.when(
            F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c)) * scale))
    values = [F.floor(level(c)).cast("int") for c in bands[:3]]
    gray = values[0] if len(bands) == 1 else luma(*values)
    return source.withColumn("gray", gray).drop("_peak")


def neighbours4(df: DataFrame, value: str, key: Key) -> DataFrame:
    """Adds ``_l _r _u _d`` with the border mirrored at the edge pixel."""
    rw, cw = along_row(key), along_col(key)
    v = F.col(value)
    wide = df.withColumn("_l", F.coalesce(F.lag(v).over(rw), F.lead(v).over(rw), v)).withColumn(
        "_r", F.coalesce(F.lead(v).over(rw), F.lag(v).over(rw), v))
    return wide.withColumn("_u", F.coalesce(F.lag(v).over(cw), F.lead(v).over(cw), v)).withColumn(
        "_d", F.coalesce(F.lead(v).over(cw), F.lag(v).over(cw), v))


def laplacian(df: DataFrame, value: str, key: Key = ("raster_id",)) -> DataFrame:
    n = neighbours4(df, value, key)
    return n.withColumn("laplacian", F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * F.col(value)).drop(
        "_l", "_r", "_u", "_d")


def _slide(fn: Callable, value: Column, spec: WindowSpec, radius: int) -> Column:
    return fn(value).over(spec.rangeBetween(-radius, radius))


def erode(df: DataFrame, value: str, radius: int = 1, key: Key = ("raster_id",), out: str | None = None) -> DataFrame:
    """Minimum over a square; outside pixels are ignored. Needs the full pixel grid."""
    half = df.withColumn("_h", _slide(F.min, F.col(value), along_row(key), radius))
    return half.withColumn(out or value, _slide(F.min, F.col("_h"), along_col(key), radius)).drop("_h")


def dilate(df: DataFrame, value: str, radius: int = 1, key: Key = ("raster_id",), out: str | None = None) -> DataFrame:
    half = df.withColumn("_h", _slide(F.max, F.col(value), along_row(key), radius))
    return half.withColumn(out or value, _slide(F.max, F.col("_h"), along_col(key), radius)).drop("_h")


def open_close(df: DataFrame, value: str, kernel: int = 3, key: Key = ("raster_id",)) -> DataFrame:
    """Opening then closing with a square of odd side.

    Erode, dilate twice, erode: the two dilations are one of double radius, and passes along the
    same axis share one shuffle, so there are four shuffles instead of eight.
    """
    if kernel <= 1:
        return df
    if kernel % 2 == 0:
        raise ValueError("kernel side must be odd")
    r, rw, cw = kernel // 2, along_row(key), along_col(key)
    a = df.withColumn("_a", _slide(F.min, F.col(value), rw, r))
    b = a.withColumn("_a", _slide(F.min, F.col("_a"), cw, r)).withColumn("_a", _slide(F.max, F.col("_a"), cw, 2 * r))
    c = b.withColumn("_a", _slide(F.max, F.col("_a"), rw, 2 * r)).withColumn("_a", _slide(F.min, F.col("_a"), rw, r))
    return c.withColumn(value, _slide(F.min, F.col("_a"), cw, r)).drop("_a")


def gaussian_weights(sigma: float = 1.0) -> tuple[float, float, float]:
    """Normalised 5-tap weights: centre, one off, two off."""
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(3)]
    total = raw[0] + 2 * raw[1] + 2 * raw[2]
    return raw[0] / total, raw[1] / total, raw[2] / total


def gaussian5(df: DataFrame, values: list[str], key: Key, sigma: float = 1.0) -> DataFrame:
    """Smooths the columns with a separable 5-tap filter, border mirrored at the edge pixel."""
    w0, w1, w2 = gaussian_weights(sigma)

    def one_pass(frame: DataFrame, spec: WindowSpec) -> DataFrame:
        packed = F.struct(*values)
        taps = frame.select(
            "*", F.lag(packed, 1).over(spec).alias("_m1"), F.lag(packed, 2).over(spec).alias("_m2"),
            F.lead(packed, 1).over(spec).alias("_p1"), F.lead(packed, 2).over(spec).alias("_p2"))

        def smooth(v: str) -> Column:
            me, m1, m2, p1, p2 = F.col(v), F.col(f"_m1.{v}"), F.col(f"_m2.{v}"), F.col(f"_p1.{v}"), F.col(f"_p2.{v}")
            left1, right1 = F.coalesce(m1, p1, me), F.coalesce(p1, m1, me)
            left2 = F.coalesce(m2, F.when(F.col("_m1").isNull(), p2).otherwise(me), me)
            right2 = F.coalesce(p2, F.when(F.col("_p1").isNull(), m2).otherwise(me), me)
            return w2 * (left2 + right2) + w1 * (left1 + right1) + w0 * me

        rest = [c for c in frame.columns if c not in values]
        return taps.select(*rest, *[smooth(v).alias(v) for v in values])

    return one_pass(one_pass(df, along_row(key)), along_col(key))


def runs(pixels: DataFrame, key: Key) -> DataFrame:
    """Adds ``run``: one number per run of adjacent pixels in a row (row and first column)."""
    rw = along_row(key)
    starts = F.when(~F.lag("col").over(rw).eqNullSafe(F.col("col") - 1), F.col("col"))
    first = F.last(F.col("_s"), ignorenulls=True).over(rw.rowsBetween(Window.unboundedPreceding, 0))
    return pixels.withColumn("_s", starts).withColumn("_s", first).withColumn(
        "run", F.shiftleft(F.col("row").cast("long"), 32) + F.col("_s")
    ).drop("_s")


def _once(pixels: DataFrame, key: Key) -> DataFrame:
    """Distinct pixels, dealt by rows, so that the windows along rows need no further shuffle."""
    return pixels.select(*key, "row", "col").repartition(*key, "row").distinct()


def run_ends(marked: DataFrame, key: Key) -> DataFrame:
    """(key, row, run, c0, c1): first and last column of every run."""
    return marked.groupBy(*key, "row", "run").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))


def run_pairs(ends: DataFrame, key: Key, reach: int) -> DataFrame:
    """(key, upper, lower): runs of a row and runs of the row below within ``reach`` columns, each pair once.

    Runs meet in the stretches of ``STRETCH`` columns that they pass, so a row costs its runs and their length, not its run pairs.
    """
    k, both = list(key), F.struct("run", "c0", "c1")
    passed = lambda low, high: F.explode(F.sequence(
        F.floor(low / STRETCH).cast("long"), F.floor(high / STRETCH).cast("long"))).alias("_s")
    upper = ends.select(*k, (F.col("row") + 1).alias("row"), both.alias("upper"), passed(F.col("c0") - reach, F.col("c1") + reach))
    lower = ends.select(*k, "row", both.alias("lower"), passed(F.col("c0"), F.col("c1")))
    low, high = F.greatest(F.col("upper.c0") - reach, F.col("lower.c0")), F.least(F.col("upper.c1") + reach, F.col("lower.c1"))
    met = upper.join(lower, [*k, "row", "_s"]).where((low <= high) & (F.floor(low / STRETCH) == F.col("_s")))
    return met.select(*k, "upper", "lower")


def pixel_components(pixels: DataFrame, key: Key = ("raster_id",), connectivity: int = 8) -> DataFrame:
    """Foreground pixels with ``component`` (its least run number).

    Runs of a row are the vertices; edges come from an equi-join of runs with the runs below.
    """
    k = list(key)
    marked = runs(pixels, key)
    pairs = run_pairs(run_ends(marked, key), key, 1 if connectivity == 8 else 0)
    edges = pairs.select(*k, F.col("upper.run").alias("src"), F.col("lower.run").alias("dst"))
    labels = connected_components(edges, None, key).withColumnsRenamed({"vertex": "run", "component": "_c"})
    return marked.join(labels, [*k, "run"], "left").withColumn(
        "component", F.coalesce("_c", "run")).drop("_c", "run")


def drop_small(components: DataFrame, minimum: int, key: Key = ("raster_id",)) -> DataFrame:
    """Keeps pixels of components with at least ``minimum`` pixels."""
    sizes = components.groupBy(*key, "component").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    return components.join(sizes.drop("_n"), [*key, "component"], "left_semi")


def component_footprints(
    pixels: DataFrame, extents: DataFrame, key: Key = ("raster_id",), minimum_area: float = 4.0,
) -> DataFrame:
    """Outer outlines of a foreground as numbers: bounds, pixels and outline area, in pixels and map units.

    ``extents``: key, width, height, transform (six affine values), factor (square metres per unit).
    Holes and what lies in them belong to the outer shape. A hole lies within one 8-connected component, so
    only the bounding box of each component, one pixel wider, is looked at: what does not reach that
    frame without crossing the component is filled. The outline runs through pixel centres; its area is
    the number of full 2x2 blocks plus half of those with three pixels, which also holds for one-pixel spurs. Both are
    counted by pairs of runs.
    """
    k = list(key)
    front = cut_lineage(pixel_components(_once(pixels, key), key, connectivity=8)).select(
        *k, F.col("component").alias("_of"), "row", "col")
    frames = front.groupBy(*k, "_of").agg(
        (F.min("row") - 1).alias("_r0"), (F.max("row") + 1).alias("_r1"),
        (F.min("col") - 1).alias("_c0"), (F.max("col") + 1).alias("_c1"))
    # a component without room for a hole is done
    frames = frames.where((F.col("_r1") - F.col("_r0") >= 4) & (F.col("_c1") - F.col("_c0") >= 4))
    cells = frames.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    back = cells.join(front, [*k, "_of", "row", "col"], "left_anti")
    ground = cut_lineage(pixel_components(back, (*key, "_of"), connectivity=4))
    edge = F.col("row").isin(F.col("_r0"), F.col("_r1")) | F.col("col").isin(F.col("_c0"), F.col("_c1"))
    open_ground = ground.where(edge).select(*k, "_of", "component").distinct()
    holes = ground.join(open_ground, [*k, "_of", "component"], "left_anti").select(*k, "row", "col")
    filled = _once(front.select(*k, "row", "col").unionByName(holes), key)
    shapes = cut_lineage(pixel_components(filled, key, connectivity=8))
    u0, u1, l0, l1 = (F.col(c) for c in ("upper.c0", "upper.c1", "lower.c0", "lower.c1"))
    # full blocks of a pair of runs, and half of the blocks in which one run ends
    full = F.greatest(F.least(u1, l1) - F.greatest(u0, l0), F.lit(0))
    ended = [(u0 < l0) & (l0 <= u1), (u0 <= l1) & (l1 < u1), (l0 < u0) & (u0 <= l1), (l0 <= u1) & (u1 < l1)]
    part = run_pairs(run_ends(runs(shapes, (*key, "component")), (*key, "component")), (*key, "component"), 1).groupBy(*k, "component").agg(
        F.sum(full + sum(F.when(c, 0.5).otherwise(0.0) for c in ended)).alias("outline_area"))
    bounds = shapes.groupBy(*k, "component").agg(
        F.count("*").alias("filled_pixels"), F.min("row").alias("r0"), F.max("row").alias("r1"),
        F.min("col").alias("c0"), F.max("col").alias("c1"))
    t = F.col("transform")

    def at(col: str, row: str, i: int) -> Column:
        return t[i] * (F.col(col) + 0.5) + t[i + 1] * (F.col(row) + 0.5) + t[i + 2]

    xs = [at(c, r, 0) for c in ("c0", "c1") for r in ("r0", "r1")]
    ys = [at(c, r, 3) for c in ("c0", "c1") for r in ("r0", "r1")]
    return (
        bounds.join(part, [*k, "component"], "left").withColumn("outline_area", F.coalesce("outline_area", F.lit(0.0)))
        .where(F.col("outline_area") >= minimum_area)
        .join(extents.select(*k, "transform", "factor"), k)
        .withColumn("box", G.box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)))
        .withColumn("area_m2", F.col("outline_area") * F.abs(t[0] * t[4] - t[1] * t[3]) * F.col("factor"))
        .drop("transform", "factor")
    )
