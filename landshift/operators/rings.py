"""Validity of polygon rings, by edges.

A ring with up to ``FEW`` edges is judged in its row, without a shuffle. The edges of longer ones stand in the cells of a grid that
they pass through, row by row of the grid, and edges of one ring that share a cell are tested for crossing or touching. A ring's cell
is its extent over the root of its number of edges, so a cell holds few edges whatever the ring's size, and no task holds a ring's pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RING = "array<struct<x:double,y:double>>"

#: Edges of a ring that are compared with each other in its row.
FEW = 24


def _turn(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    return f"signum(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _between(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Whether c, which lies on the line through a and b, lies between them."""
    return f"({cx} between least({ax}, {bx}) and greatest({ax}, {bx}) and {cy} between least({ay}, {by}) and greatest({ay}, {by}))"


def _kept_points(ring: Column) -> Column:
    """Points without those that repeat the one before."""
    points = F.filter(ring, lambda p: p.isNotNull())
    return F.filter(
        F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.get(points, i - 1).alias("b"))),
        lambda p: p["b"].isNull() | (p["b"]["x"] != p["x"]) | (p["b"]["y"] != p["y"]))


def ring_edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, i, n, x0, y0, x1, y1) of every edge with a length; ``i`` runs from 0, ``n`` is their number in the ring.

    Points that repeat the one before are left out first, so they are no fault.
    """
    rows = rings.select(F.col(key), _kept_points(F.col(ring)).alias("p")).where("size(p) > 1")
    count = F.size("p") - 1
    at = rows.select(key, "p", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return at.select(
        key, "i", count.alias("n"), *[F.get("p", F.col("i") + k)[c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")])


def _cells(edges: DataFrame, key: str) -> DataFrame:
    """The edges, once for every cell (cx, cy) that they pass through."""
    extent = edges.groupBy(key).agg(F.expr(
        "greatest(max(greatest(x0, x1)) - min(least(x0, x1)), max(greatest(y0, y1)) - min(least(y0, y1))) / ceil(sqrt(max(n)))").alias("c"))
    wide = 1e-6
    rows = edges.join(extent, key).withColumn("cy", F.explode(F.expr(
        f"sequence(cast(floor(least(y0, y1) / c - {wide}) as bigint), cast(floor(greatest(y0, y1) / c + {wide}) as bigint))")))
    # where the edge enters and leaves the row of cells, a little wider against rounding
    at = "if(y1 = y0, {end}, x0 + (x1 - x0) * greatest(0D, least(1D, ({y} * c - y0) / (y1 - y0))))"
    low, high = at.format(y=f"(cy - {wide})", end="x0"), at.format(y=f"(cy + 1 + {wide})", end="x1")
    return rows.withColumn("cx", F.explode(F.expr(
        f"sequence(cast(floor(least({low}, {high}) / c - {wide}) as bigint), cast(floor(greatest({low}, {high}) / c + {wide}) as bigint))")))


def _fault_of(i: str, j: str, n: str, points: tuple[str, ...]) -> str:
    """Whether edge j > i of a ring with n edges meets edge i where it must not. ``points``: x and y of both ends of i, then of j."""
    a, b, c, d = zip(points[::2], points[1::2])
    turns = [_turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)]
    on = [f"({t} = 0 and {_between(*e, *f, *p)})" for t, e, f, p in
          zip(turns, (a, a, c, c), (b, b, d, d), (c, d, a, b))]
    touch = f"(({turns[0]} <> {turns[1]}) and ({turns[2]} <> {turns[3]}) and {turns[0]} * {turns[1]} * {turns[2]} * {turns[3]} <> 0) or {' or '.join(on)}"
    # neighbours share a point; they only must not fold back onto each other
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    back = f"({bx} - {ax}) * ({dy} - {cy}) - ({by} - {ay}) * ({dx} - {cx}) = 0 and ({bx} - {ax}) * ({dx} - {cx}) + ({by} - {ay}) * ({dy} - {cy}) < 0"
    return f"if({j} = {i} + 1 or ({i} = 0 and {j} = {n} - 1), {back}, {touch})"


def ring_faults(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, fault) of the rings that are no valid polygon: the first that holds of NOT_A_RING (null, a point without finite
    coordinates, fewer than three edges), OPEN, NO_AREA, CROSSING (edges cross, touch or fold back).

    Keys name rings; a null key is never reported. Valid rings give no row.
    """
    point_ok = F.forall(F.col(ring), lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
                        & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))

    def once(df: DataFrame, *cols: Column) -> DataFrame:
        """Adds columns that are computed once a row, however often they are used later."""
        return df.select("*", F.inline(F.array(F.struct(*cols))))

    whole = rings.where(F.col(key).isNotNull()).select(key, ring)
    points = once(whole, F.when(F.coalesce(point_ok, F.lit(False)), _kept_points(F.col(ring))).alias("p"))
    edges = F.transform(F.filter("p", lambda _, i: i < F.size("p") - 1), lambda a, i: F.struct(
        i.alias("i"), a["x"].cast("double").alias("x0"), a["y"].cast("double").alias("y0"), F.get("p", i + 1)["x"].cast("double").alias("x1"),
        F.get("p", i + 1)["y"].cast("double").alias("y1")))
    judged = once(
        once(points, edges.alias("e"), F.greatest(F.size("p") - 1, F.lit(0)).alias("n")),
        ((F.get("e", F.col("n") - 1)["x1"] != F.get("e", F.lit(0))["x0"])
         | (F.get("e", F.col("n") - 1)["y1"] != F.get("e", F.lit(0))["y0"])).alias("open"),
        F.abs(F.aggregate("e", F.lit(0.0), lambda s, a: s + (a["x0"] * a["y1"] - a["x1"] * a["y0"]))).alias("area2"))
    plain = (
        F.when(F.col("p").isNull() | (F.col("n") < 3), "NOT_A_RING").when(F.col("open"), "OPEN").when(F.col("area2") <= 0, "NO_AREA"))
    met = _fault_of("a.i", "b.i", "n", ("a.x0", "a.y0", "a.x1", "a.y1", "b.x0", "b.y0", "b.x1", "b.y1"))
    crossing = F.when(F.expr(f"exists(e, a -> exists(e, b -> a.i < b.i and ({met})))"), "CROSSING")
    is_long = F.col("n") > FEW
    here = once(judged, F.coalesce(plain, F.when(~is_long, crossing)).alias("fault")).select(key, "fault").where("fault is not null")
    # long rings that are valid so far
    cells = _cells(ring_edges(judged.where(is_long & plain.isNull()).select(key, ring), key, ring), key)
    other = cells.select(key, "cx", "cy", F.col("i").alias("j"), *[F.col(a).alias(b) for a, b in (("x0", "u0"), ("y0", "v0"), ("x1", "u1"), ("y1", "v1"))])
    crossed = cells.join(other, [key, "cx", "cy"]).where(F.col("i") < F.col("j")).where(
        F.expr(_fault_of("i", "j", "n", ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")))).select(key).distinct()
    rest = judged.where(is_long & plain.isNull()).select(key).join(crossed, key, "left_semi")
    return here.unionByName(rest.select(key, F.lit("CROSSING").alias("fault")))
