"""Plan comparison on real outlines, by scan lines.

A shape is one or more rings (holes and parts too: what an odd number of rings holds is inside). On a lattice of cells a ring is
the list of places where its edges cross the middle of a row; the places of all shapes of a case, in order, cut the row into
segments that lie in the same shapes throughout. So cost follows the length of the outlines, never the number of cells, and
a cell counts as a shape's when its centre lies in it, as in the cell form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.operators.rings import ring_edges

SHAPES = ("approved", "old", "new", "parcel")


#: Rows of cells that stay together in a task.
BAND_ROWS = 64


def _spanned(shapes: DataFrame, ids: list[str], cell_m: float, ring: str = "ring") -> DataFrame:
    """(ids, x0, y0, x1, y1, first, last): edges and the rows of cells whose middle they cross, ``last`` included."""
    edges = ring_edges(shapes.select(F.struct(*ids).alias("_id"), ring), "_id", ring)
    first, until = (F.ceil(f(F.col("y0"), F.col("y1")) / cell_m - 0.5).cast("long") for f in (F.least, F.greatest))
    return edges.select("_id.*", "x0", "y0", "x1", "y1", first.alias("first"), (until - 1).alias("last")).where("first <= last")


def _laid_out(edges: DataFrame, by: list[str], cell_m: float, rows: Column, halo: Column) -> DataFrame:
    """Adds row and at, the place of the crossing, and _band: edges are dealt to tasks by bands of ``rows`` rows before they are laid
    out, so that what follows per case and row needs no shuffle. A band also holds ``halo`` rows of its neighbours."""
    # Many rows come of one edge after the shuffle, so more tasks than its own size asks for.
    tasks = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = edges.withColumn("_band", F.explode(F.sequence(F.floor((F.col("first") - halo) / rows), F.floor((F.col("last") + halo) / rows))))
    start = F.col("_band") * rows
    laid = banded.repartition(tasks, *by, "_band").withColumn("row", F.explode(F.sequence(
        F.greatest(F.col("first"), start - halo), F.least(F.col("last"), start + (rows - 1) + halo))))
    x = F.col("x0") + ((F.col("row") + 0.5) * cell_m - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    return laid.withColumn("at", F.ceil(x / cell_m - 0.5).cast("long"))


def intervals(crossed: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, low, high) of one shape's runs of cells, ``high`` left out. Two crossings at one place change nothing."""
    line = Window.partitionBy(*by, "row").orderBy("at")
    turns = crossed.groupBy(*by, "row", "at").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    runs = turns.withColumn("_n", F.row_number().over(line)).withColumn("high", F.lead("at").over(line))
    return runs.where("_n % 2 = 1 and high is not null").select(*by, "row", F.col("at").alias("low"), "high")


def inset_boxes(parcels: DataFrame, by: list[str], cell_m: float, setback: str = "setback_m") -> DataFrame:
    """(by, first, last, low, high): boxes of cells, apart from each other, whose disc of the setback lies in the parcel.

    Equal runs of rows that follow each other are a block. Rows of cells that have only the block within reach are inset at once;
    for the others each run counts in the rows within reach, shortened by the disc's half width there, and the cells that all of
    these rows count are inside.
    """
    reach = parcels.groupBy(*by).agg(F.coalesce(F.round(F.max(setback) / cell_m), F.lit(0)).cast("long").alias("_k")).where("_k >= 0")
    key, k = [*by, "_k"], F.col("_k")
    rows = F.greatest(F.lit(BAND_ROWS), 4 * k)
    crossed = _laid_out(_spanned(parcels.join(reach, by), key, cell_m), by, cell_m, rows, k)
    key.append("_band")
    runs = intervals(crossed, key)
    number = F.row_number().over(Window.partitionBy(*key, "low", "high").orderBy("row"))
    blocks = runs.withColumn("_n", F.col("row") - number).groupBy(*key, "low", "high", "_n").agg(F.min("row").alias("b0"), F.max("row").alias("b1"))

    b0, b1, start = F.col("b0"), F.col("b1"), F.col("_band") * rows
    end = start + (rows - 1)
    some = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    alone = lambda t: F.struct(t.alias("first"), t.alias("last"), F.lit(False).alias("all"))
    clear = F.struct(F.greatest(b0 + k, start).alias("first"), F.least(b1 - k, end).alias("last"), F.lit(True).alias("all"))
    near = F.when(b1 - b0 >= 2 * k, F.concat(some(b0 - k, b0 + k - 1), some(b1 - k + 1, b1 + k))).otherwise(some(b0 - k, b1 + k))
    near = F.transform(F.filter(near, lambda t: t.between(start, end)), alone)
    seen = blocks.withColumn("t", F.explode(F.concat(F.array(clear), near))).where("t.first <= t.last")
    line = F.col("t.first")
    half = lambda s: F.floor(F.sqrt((k * k - (s - line) * (s - line)).cast("double"))).cast("long")
    parts = F.when(F.col("t.all"), F.array(F.struct(k.alias("half"), (2 * k + 1).alias("step")))).otherwise(
        F.transform(some(F.greatest(b0, line - k), F.least(b1, line + k)), lambda s: F.struct(half(s).alias("half"), F.lit(1).cast("long").alias("step"))))
    moved = seen.select(*key, line.alias("first"), F.col("t.last").alias("last"), "low", "high", F.inline(parts)).where("low + half < high - half")
    marks = moved.select(*key, "first", "last", F.inline(F.array(
        F.struct((F.col("low") + F.col("half")).alias("low"), F.col("step").alias("step")),
        F.struct((F.col("high") - F.col("half")).alias("low"), (-F.col("step")).alias("step")))))
    at = Window.partitionBy(*key, "first", "last").orderBy("low")
    # Of marks at one place all but the last have no length, and the last one has met them all.
    met = marks.select(*by, "_k", "first", "last", "low", F.lead("low").over(at).alias("high"),
                       F.sum("step").over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("step"))
    return met.where("step = 2 * _k + 1 and low < high").select(*by, "first", "last", "low", "high")


def overlay(shapes: DataFrame, by: list[str], cell_m: float, setback: str = "setback_m") -> DataFrame:
    """(by, row, at, length, approved, old, new, parcel, inner): segments of rows and the shapes that hold them.

    ``shapes``: by, src (one of ``SHAPES``), ring, and for parcels the setback in metres; inner: the parcel without its setback.
    """
    inner = inset_boxes(shapes.where("src = 'parcel'"), by, cell_m, setback)
    sides = inner.select(
        *by, F.lit("inner").alias("src"), F.explode(F.array("low", "high")).alias("_at"), "first", "last").select(
        *by, "src", (F.col("_at") * cell_m).cast("double").alias("x0"), F.lit(0.0).alias("y0"),
        (F.col("_at") * cell_m).cast("double").alias("x1"), F.lit(1.0).alias("y1"), "first", "last")
    marks = _laid_out(_spanned(shapes, [*by, "src"], cell_m).unionByName(sides), by, cell_m, F.lit(BAND_ROWS), F.lit(0))
    names = (*SHAPES, "inner")
    bit = F.coalesce(*[F.when(F.col("src") == s, 1 << i) for i, s in enumerate(names)], F.lit(0))
    line = Window.partitionBy("row", *by, "_band").orderBy("at")
    held = F.bit_xor("_bit").over(line.rowsBetween(Window.unboundedPreceding, 0))
    # Of crossings at one place all but the last have no length, and the last one has met them all.
    met = marks.select(*by, "_band", "row", "at", bit.alias("_bit")).select(
        *by, "row", "at", (F.lead("at").over(line) - F.col("at")).alias("length"), held.alias("_in")).where("length > 0")
    return met.select(*by, "row", "at", "length", *[F.col("_in").bitwiseAND(1 << i).cast("boolean").alias(s) for i, s in enumerate(names)])


def plan_comparison_outlines(shapes: DataFrame, by: list[str], cell_m: float, setback: str = "setback_m") -> DataFrame:
    """The areas of ``plan_areas`` for any outlines; one row per case that has a cell. Equal to the box form for boxes on the lattice."""
    a, o, n, p, i = (F.col(s) for s in (*SHAPES, "inner"))

    def size(cond: Column, name: str) -> Column:
        return (F.coalesce(F.sum(F.when(cond, F.col("length"))), F.lit(0)) * F.lit(float(cell_m * cell_m))).alias(name)

    return overlay(shapes, by, cell_m, setback).groupBy(*by).agg(
        size(a, "approved_area"), size(o, "old_area"), size(n, "new_area"), size(n & ~o, "added_area"),
        size(n & ~o & ~a, "added_outside_approval_area"), size(a & o & ~n, "removed_approved_area"),
        size(n & p & ~i, "setback_zone_area"), size(n & p, "_inside"), size(p, "_parcel"),
    ).withColumn("site_coverage_ratio", F.coalesce(
        F.col("_inside") / F.when(F.col("_parcel") != 0, F.col("_parcel")), F.lit(0.0))).drop("_inside", "_parcel").withColumn(
        "cell_m", F.lit(float(cell_m)))
