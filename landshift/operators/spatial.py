"""Spatial joins on grid buckets, plan comparison, cell sets, common grids, resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from landshift.functions import boxes as G
from landshift.functions.constants import AREA_EPSILON

#: Side of the smallest cells in which boxes look up parcels; a box is at most half as long as its cell.
LOOKUP_M = 128.0
#: Coordinates beyond it are no places; such boxes don't look up.
FAR_M = 1e12
#: Parcels of a cell that a box is compared with in its own row.
FEW_PARCELS = 256
CELL = ["crs", "_level", "_bx", "_by"]

#: Rows of cells that stay together in a task when boxes are laid out as runs.
BAND_ROWS = 64


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def _span(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(low, size), _cell(high, size)))


def _bucketed(df: DataFrame, box: str, size: float, margin: Column | float = 0.0) -> DataFrame:
    b, m = F.col(box), margin if isinstance(margin, Column) else F.lit(float(margin))
    return df.withColumn("_bx", _span(b["min_x"] - m, b["max_x"] + m, size)).withColumn(
        "_by", _span(b["min_y"] - m, b["max_y"] + m, size)
    )


def box_join(
    left: DataFrame, right: DataFrame, left_box: str, right_box: str, bucket_m: float,
    keep: Callable[[Column, Column], Column], keys: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of rows whose boxes meet, as an equi-join on covered buckets.

    A pair shares several buckets; it is kept only in the one that holds the lower left corner
    of the common box, so no distinct is needed.
    """
    lo = _bucketed(left, left_box, bucket_m)
    ro = _bucketed(right, right_box, bucket_m)
    joined = lo.join(ro, [*keys, "_bx", "_by"])
    a, b = F.col(left_box), F.col(right_box)
    owner = (
        (F.col("_bx") == _cell(F.greatest(a["min_x"], b["min_x"]), bucket_m))
        & (F.col("_by") == _cell(F.greatest(a["min_y"], b["min_y"]), bucket_m))
    )
    return joined.where(owner & keep(a, b)).drop("_bx", "_by")


def parcel_overlaps(changes: DataFrame, parcels: DataFrame, bucket_m: float = 128.0) -> DataFrame:
    """Every parcel a change overlaps by more than the area epsilon, with its share of the change."""
    c = changes.select("change_id", F.col("box").alias("change_box"), F.col("crs"))
    p = parcels.select(
        F.col("parcel_id").alias("overlap_parcel_id"), F.col("box").alias("parcel_box"), F.col("crs")
    )
    common = G.area(F.col("change_box"), F.col("parcel_box"))
    return box_join(
        c, p, "change_box", "parcel_box", bucket_m,
        lambda a, b: G.area(a, b) > AREA_EPSILON, keys=("crs",),
    ).select(
        "change_id",
        F.col("overlap_parcel_id").alias("parcel_id"),
        common.alias("overlap_area"),
        F.least(F.lit(100.0), 100 * common / G.area(F.col("change_box"))).alias("overlap_percent"),
        G.covers(F.col("parcel_box"), F.col("change_box")).alias("covered"),
    )


def parcel_match(overlaps: DataFrame, changes: DataFrame) -> DataFrame:
    """Best parcel per change (area descending, id ascending); unmatched changes stay.

    One hash aggregate per change instead of a ranking window: the best row is the least of
    (-area, id), so partial aggregation runs before the shuffle.
    """
    best = overlaps.groupBy("change_id").agg(
        F.min(F.struct(
            (-F.col("overlap_area")).alias("rank"), "parcel_id", "overlap_area", "overlap_percent",
            "covered",
        )).alias("best"),
        F.count("*").alias("overlap_count"),
    )
    n = F.coalesce(F.col("overlap_count"), F.lit(0))
    return changes.select("change_id").join(best, "change_id", "left").select(
        "change_id",
        F.col("best.parcel_id").alias("matched_parcel_id"),
        F.coalesce("best.overlap_area", F.lit(0.0)).alias("match_area"),
        F.coalesce("best.overlap_percent", F.lit(0.0)).alias("match_percent"),
        ((n > 0) & ~F.coalesce("best.covered", F.lit(True))).alias("boundary_crossing"),
        (n > 1).alias("multiple_parcel_ambiguity"),
        (n == 0).alias("no_parcel_match"),
        n.alias("overlap_count"),
    )


def _lookup_step() -> Column:
    return F.lit(LOOKUP_M) * F.pow(F.lit(2.0), F.col("_level"))


def has_sides(box: Column) -> Column:
    return (box["min_x"] + box["min_y"] + box["max_x"] + box["max_y"]).isNotNull()


def in_reach(box: Column) -> Column:
    return F.greatest(*[F.abs(box[side]) for side in G.SIDES]) <= FAR_M


def lookup_level(box: Column) -> Column:
    """How often the smallest cells double until one is twice as long as the box; null where a side is missing or far."""
    side = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    return F.when(has_sides(box) & in_reach(box), F.ceil(F.log2(F.greatest(side / (LOOKUP_M / 2), F.lit(1.0)))).cast("int"))


def lookup_home(df: DataFrame, box: str) -> DataFrame:
    """Adds the one cell in which a box looks up parcels: that of its lower left corner."""
    b = F.col(box)
    at = df.withColumn("_level", lookup_level(b))
    return at.withColumn("_bx", F.floor(b["min_x"] / _lookup_step())).withColumn("_by", F.floor(b["min_y"] / _lookup_step()))


def lookup_cells(land: DataFrame, levels: list[int]) -> DataFrame:
    """Every parcel in all cells, of the given levels, that may be home of a box that overlaps it."""
    b, margin = F.col("box"), _lookup_step() * 0.51  # half a cell is the longest box; the rest is for rounding
    out = land.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    for axis in "xy":
        low, high = b[f"min_{axis}"] - margin, b[f"max_{axis}"]
        out = out.withColumn(f"_b{axis}", F.explode(F.sequence(F.floor(low / _lookup_step()), F.floor(high / _lookup_step()))))
    return out


def look_up_parcels(rows: DataFrame, box: str, cells: DataFrame, spread: bool = False) -> DataFrame:
    """Rows with their home cell meet the parcels of that cell, in one row: the parcel of ``parcel_match`` with its columns
    as struct ``land`` and the flags. Cells are grouped, so a row has one partner and the join can split a crowded cell. ``spread``: cells
    are too many to be broadcast.
    """
    entry = F.struct(*[c for c in cells.columns if c not in CELL])
    held = cells.groupBy(*CELL).agg(F.collect_list(entry).alias("_parcels"))
    if spread:  # the planner takes the cells for as small as the parcels' files
        held = held.hint("merge")
    # Sides travel flat, without the frame of a struct.
    boxes = [f.name for f in rows.schema if f.dataType.simpleString().startswith("struct<min_x")]
    flat = rows.select(*[c for c in rows.columns if c not in boxes],
                       *[F.col(c)[side].alias(f"{c}.{side}") for c in boxes for side in G.SIDES])
    met = flat.join(held, CELL, "left").select(
        *[c for c in rows.columns if c not in (*boxes, *CELL)], "_parcels",
        *[G.box(*[F.col(f"`{c}.{side}`") for side in G.SIDES]).alias(c) for c in boxes])
    a = F.col(box)
    hits = met.withColumn("_hits", F.filter("_parcels", lambda p: G.area(a, p["box"]) > AREA_EPSILON)).drop("_parcels")
    best = hits.withColumn("_best", F.array_min(F.transform("_hits", lambda p: F.struct(
        (-G.area(a, p["box"])).alias("rank"), p["parcel_id"].alias("parcel_id"), G.covers(p["box"], a).alias("covered"), p.alias("land")))))
    n = F.when(F.col("_hits").isNotNull(), F.size("_hits")).otherwise(0)
    return best.select(
        *rows.drop(*CELL).columns, F.col("_best.land").alias("land"),
        ((n > 0) & ~F.coalesce("_best.covered", F.lit(True))).alias("boundary_crossing"),
        (n > 1).alias("multiple_parcel_ambiguity"), (n == 0).alias("no_parcel_match"),
    )


def setback_zone(new: Column, parcel: Column, setback: Column) -> Column:
    """Area of a footprint in the strip along the parcel edge; all of it where no inside is left."""
    inner = G.inset(parcel, setback)
    inside = F.when(G.is_empty(inner), F.lit(0.0)).otherwise(G.area(new, inner))
    return F.when(setback == 0, F.lit(0.0)).otherwise(G.area(new, parcel) - inside)


def plan_areas(approved: Column, old: Column, new: Column, parcel: Column, setback: Column) -> dict[str, Column]:
    """Plan-comparison areas of boxes by inclusion and exclusion."""
    a, o, n, p = approved, old, new, parcel
    return {
        "approved_area": G.area(a),
        "old_area": G.area(o),
        "new_area": G.area(n),
        "added_area": G.area(n) - G.area(n, o),
        "added_outside_approval_area": G.area(n) - G.area(n, o) - G.area(n, a) + G.area(n, o, a),
        "removed_approved_area": G.area(a, o) - G.area(a, o, n),
        "setback_zone_area": setback_zone(n, p, setback),
        "site_coverage_ratio": F.coalesce(
            G.area(n, p) / F.when(G.area(p) == 0, F.lit(None)).otherwise(G.area(p)), F.lit(0.0)
        ),
    }


def plan_comparison_cells(memberships: DataFrame, by: list[str], cell_m: float) -> DataFrame:
    """The same areas for arbitrary shapes given as cells.

    ``memberships``: ``by`` columns, cx, cy, src in (approved, old, new, parcel, inner), or runs of cells (see
    ``box_cells``). Flags per shape and cell, or per stretch between two ends of runs, are counted by cells.
    """
    shapes = ("approved", "old", "new", "parcel", "inner")
    if "cx_end" in memberships.columns:
        line = Window.partitionBy(*by, "_band", "cy").orderBy("at")
        marks = memberships.select(*by, "_band", "cy", "src", F.inline(F.array(
            F.struct(F.col("cx").alias("at"), F.lit(1).alias("step")), F.struct(F.col("cx_end").alias("at"), F.lit(-1).alias("step")))))
        # Of marks at one place all but the last have no length, and the last one has met them all.
        flags = marks.select(*by, (F.lead("at").over(line) - F.col("at")).alias("_cells"), *[
            (F.sum(F.when(F.col("src") == s, F.col("step")).otherwise(0)).over(
                line.rowsBetween(Window.unboundedPreceding, 0)) > 0).cast("int").alias(s) for s in shapes]).where("_cells > 0")
    else:
        flags = memberships.groupBy(*by, "cx", "cy").agg(
            *[F.max(F.when(F.col("src") == s, 1).otherwise(0)).alias(s) for s in shapes]
        ).withColumn("_cells", F.lit(1).cast("long"))
    a, o, n, p, i = (F.col(s) == 1 for s in shapes)
    met = F.greatest(*shapes) == 1  # a gap between two shapes has no cell of any

    def size(cond: Column, name: str) -> Column:
        return (F.coalesce(F.sum(F.when(cond, F.col("_cells"))), F.lit(0)) * F.lit(cell_m * cell_m)).alias(name)

    counted = flags.where(met).groupBy(*by).agg(
        size(a, "approved_area"), size(o, "old_area"), size(n, "new_area"),
        size(n & ~o, "added_area"), size(n & ~o & ~a, "added_outside_approval_area"),
        size(a & o & ~n, "removed_approved_area"), size(n & p & ~i, "setback_zone_area"),
        size(n & p, "_inside"), size(p, "_parcel"),
    )
    return counted.withColumn(
        "site_coverage_ratio",
        F.coalesce(F.col("_inside") / F.when(F.col("_parcel") != 0, F.col("_parcel")), F.lit(0.0)),
    ).drop("_inside", "_parcel").withColumn("cell_m", F.lit(float(cell_m)))


def box_cells(df: DataFrame, box: str, cell_m: float, by: list[str] | None = None) -> DataFrame:
    """Cells whose centre lies in the box.

    With ``by`` a row of cells is one run, from cx up to cx_end, which is left out; runs of a key are dealt to tasks by
    bands (_band) of rows before they are laid out, so that what follows per key and row needs no shuffle of cells.
    """
    b = F.col(box)

    def ends(low: str, high: str) -> tuple[Column, Column]:
        return F.ceil(b[low] / cell_m - 0.5).cast("long"), (F.ceil(b[high] / cell_m - 0.5) - 1).cast("long")

    def span(first: Column, last: Column) -> Column:
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>")))

    x, y = ends("min_x", "max_x"), ends("min_y", "max_y")
    if by is None:
        return df.withColumn("cx", span(*x)).withColumn("cy", span(*y))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, band = F.col("_band") * BAND_ROWS, F.floor(y[0] / BAND_ROWS)
    banded = df.where((x[0] <= x[1]) & (y[0] <= y[1])).withColumn("_band", F.explode(F.sequence(band, F.floor(y[1] / BAND_ROWS))))
    rows = banded.repartition(tasks, *by, "_band").withColumn(
        "cy", span(F.greatest(y[0], first), F.least(y[1], first + (BAND_ROWS - 1))))
    return rows.withColumn("cx", x[0]).withColumn("cx_end", x[1] + 1)


def ring_cells(df: DataFrame, ring: str, cell_m: float) -> DataFrame:
    """Cells whose centre lies in a ring array<struct<x,y>>."""
    r = F.col(ring)
    bounded = df.withColumn("_b", G.box(
        F.array_min(F.transform(r, lambda p: p["x"])), F.array_min(F.transform(r, lambda p: p["y"])),
        F.array_max(F.transform(r, lambda p: p["x"])), F.array_max(F.transform(r, lambda p: p["y"])),
    ))
    cells = box_cells(bounded, "_b", cell_m).drop("_b")
    return cells.where(G.ring_contains(r, (F.col("cx") + 0.5) * cell_m, (F.col("cy") + 0.5) * cell_m))


def dissolve(cells: DataFrame, by: list[str]) -> DataFrame:
    """Union of cell sets per group; of runs of cells, what no earlier run of the row holds."""
    if "cx_end" in cells.columns:
        line = Window.partitionBy(*by, "_band", "cy").orderBy("cx")
        held = F.max("cx_end").over(line.rowsBetween(Window.unboundedPreceding, -1))
        return cells.select(*by, "_band", "cy", F.greatest(F.col("cx"), held).alias("cx"), "cx_end").where("cx < cx_end")
    return cells.select(*by, "cx", "cy").distinct()


def boundary_hits(footprints: DataFrame, boundaries: DataFrame, key: str, box: str, bucket_m: float = 512.0) -> DataFrame:
    """Public boundaries met by a footprint; an edge that only touches counts."""
    f = footprints.select(key, F.col(box).alias("_fb"), "crs")
    b = boundaries.select("boundary_id", F.col("box").alias("_bb"), "crs")
    return box_join(f, b, "_fb", "_bb", bucket_m, G.touches, keys=("crs",)).select(key, "boundary_id")


def derive_extents(parcels: DataFrame, by: str) -> DataFrame:
    b = F.col("box")
    return parcels.groupBy(by).agg(
        F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"),
        F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y"),
        F.count("*").alias("parcel_count"),
        F.sum(G.area(b)).alias("parcel_area"),
    )


def tessellate(extents: DataFrame, wards: int, parcels_per_ward: int, margin: float) -> DataFrame:
    """Regular wards (columns) and parcels (rows) of each extent; parcels shrink by the margin."""
    w = (F.col("max_x") - F.col("min_x")) / wards
    h = (F.col("max_y") - F.col("min_y")) / parcels_per_ward
    x0, y0 = F.col("min_x") + F.col("ward_index") * w, F.col("min_y") + F.col("parcel_index") * h
    return (
        extents.withColumn("ward_index", F.explode(F.sequence(F.lit(0), F.lit(wards - 1))))
        .withColumn("parcel_index", F.explode(F.sequence(F.lit(0), F.lit(parcels_per_ward - 1))))
        .withColumn("record_index", F.col("ward_index") * parcels_per_ward + F.col("parcel_index"))
        .withColumn("ward_box", G.box(x0, F.col("min_y"), x0 + w, F.col("max_y")))
        .withColumn("parcel_box", G.box(x0 + margin, y0 + margin, x0 + w - margin, y0 + h - margin))
        .drop("min_x", "min_y", "max_x", "max_y")
    )


def pair_overlap(before: Column, after: Column) -> Column:
    """Shared area over the smaller area."""
    smaller = F.least(G.area(before), G.area(after))
    return F.coalesce(G.area(before, after) / F.when(smaller != 0, smaller), F.lit(0.0))


def resolution_ratio(*resolutions: Column) -> Column:
    return F.greatest(*resolutions) / F.least(*resolutions)


def common_grid(pairs: DataFrame) -> DataFrame:
    """Grid shared by two rasters: common bounds, coarser resolution, origin top left.

    Needs old_box, new_box, old_res, new_res; adds grid bounds, size and an error code.
    """
    g = G.overlap_box(F.col("old_box"), F.col("new_box"))
    res = F.greatest("old_res", "new_res")
    return (
        pairs.withColumn("_g", g).withColumn("resolution", res)
        .withColumn("grid_width", F.floor((F.col("_g.max_x") - F.col("_g.min_x")) / F.col("resolution")))
        .withColumn("grid_height", F.floor((F.col("_g.max_y") - F.col("_g.min_y")) / F.col("resolution")))
        .withColumn("error_code", F.when(
            (F.col("_g.min_x") >= F.col("_g.max_x")) | (F.col("_g.min_y") >= F.col("_g.max_y"))
            | (F.col("grid_width") < 1) | (F.col("grid_height") < 1), "INSUFFICIENT_OVERLAP"))
        .withColumn("left", F.col("_g.min_x")).withColumn("top", F.col("_g.max_y"))
        .withColumn("right", F.col("left") + F.col("grid_width") * F.col("resolution"))
        .withColumn("bottom", F.col("top") - F.col("grid_height") * F.col("resolution"))
        .drop("_g")
    )


def resample(pixels: DataFrame, grids: DataFrame, method: str = "nearest") -> DataFrame:
    """Source pixels on a target grid of the same CRS.

    ``pixels``: raster_id, row, col, value, valid. ``grids``: one row per (grid_id, raster_id)
    with left, top, resolution, grid_width, grid_height, src_left, src_top, src_res. Targets come
    from sequences; the source is met by an equi-join on its (raster_id, row, col). A grid without rows
    or columns, or with an error code, has no pixels.
    """
    whole = (F.col("grid_width") >= 1) & (F.col("grid_height") >= 1)
    if "error_code" in grids.columns:
        whole &= F.col("error_code").isNull()
    target = (
        grids.where(whole)
        .withColumn("t_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid_height") - 1)))
        .withColumn("t_col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid_width") - 1)))
        .withColumn("_sx", (F.col("left") + (F.col("t_col") + 0.5) * F.col("resolution") - F.col("src_left")) / F.col("src_res"))
        .withColumn("_sy", (F.col("src_top") - (F.col("top") - (F.col("t_row") + 0.5) * F.col("resolution"))) / F.col("src_res"))
    )
    src = pixels.select(
        "raster_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
        F.col("value").cast("double").alias("value"), "valid",
    )
    near_row, near_col = F.floor("_sy"), F.floor("_sx")
    if method == "nearest":
        hit = target.withColumn("row", near_row).withColumn("col", near_col)
        return hit.join(src, ["raster_id", "row", "col"], "left").select(
            "grid_id", "raster_id", F.col("t_row").alias("row"), F.col("t_col").alias("col"),
            "value", F.coalesce("valid", F.lit(False)).alias("valid"),
        )
    fx, fy = F.col("_sx") - 0.5, F.col("_sy") - 0.5
    corner = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)
    ]))
    wx, wy = fx - F.floor(fx), fy - F.floor(fy)
    spread = (
        target.withColumn("_k", corner)
        .withColumn("_w", F.when(F.col("_k.dx") == 1, wx).otherwise(1 - wx)
                    * F.when(F.col("_k.dy") == 1, wy).otherwise(1 - wy))
        .withColumn("_near", (near_row == F.floor(fy) + F.col("_k.dy")) & (near_col == F.floor(fx) + F.col("_k.dx")))
        .withColumn("row", (F.floor(fy) + F.col("_k.dy")).cast("long"))
        .withColumn("col", (F.floor(fx) + F.col("_k.dx")).cast("long"))
    )
    met = spread.join(src, ["raster_id", "row", "col"], "left")
    ok = F.coalesce(F.col("valid"), F.lit(False))
    weight = F.sum(F.when(ok, F.col("_w")).otherwise(0.0))
    return met.groupBy("grid_id", "raster_id", "t_row", "t_col").agg(
        (F.sum(F.when(ok, F.col("_w") * F.col("value")).otherwise(0.0))
         / F.when(weight != 0, weight)).alias("value"),
        F.coalesce(F.bool_or(F.col("_near") & ok), F.lit(False)).alias("valid"),
    ).withColumnsRenamed({"t_row": "row", "t_col": "col"})
