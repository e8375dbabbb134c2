"""Closed-form geometry on boxes, rings and affine transforms.

A box is struct<min_x,min_y,max_x,max_y>; a line along an axis is a box without width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SIDES = ("min_x", "min_y", "max_x", "max_y")


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    values = zip(SIDES, (min_x, min_y, max_x, max_y))
    return F.struct(*[v.cast("double").alias(name) for name, v in values])


def point_box(x: Column, y: Column) -> Column:
    return box(x, y, x, y)


def _many(fn, items: list[Column]) -> Column:
    return items[0] if len(items) == 1 else fn(*items)


def overlap_box(*boxes: Column) -> Column:
    """Common box of all; inverted sides where there is none."""
    return box(
        _many(F.greatest, [b["min_x"] for b in boxes]),
        _many(F.greatest, [b["min_y"] for b in boxes]),
        _many(F.least, [b["max_x"] for b in boxes]),
        _many(F.least, [b["max_y"] for b in boxes]),
    )


def area(*boxes: Column) -> Column:
    """Area of the intersection of the given boxes (one box: its own area)."""
    width = _many(F.least, [b["max_x"] for b in boxes]) - _many(F.greatest, [b["min_x"] for b in boxes])
    height = _many(F.least, [b["max_y"] for b in boxes]) - _many(F.greatest, [b["min_y"] for b in boxes])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def strict_overlap(a: Column, b: Column) -> Column:
    """Common box, null where the boxes only touch or are apart."""
    common = overlap_box(a, b)
    return F.when((common["min_x"] < common["max_x"]) & (common["min_y"] < common["max_y"]), common)


def covers(outer: Column, inner: Column) -> Column:
    return (
        (outer["min_x"] <= inner["min_x"]) & (outer["min_y"] <= inner["min_y"])
        & (outer["max_x"] >= inner["max_x"]) & (outer["max_y"] >= inner["max_y"])
    )


def touches(a: Column, b: Column) -> Column:
    """Closed intersection: a shared edge or corner counts."""
    return (
        (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"])
        & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])
    )


def gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high)


def distance(a: Column, b: Column) -> Column:
    gx = gap(a["min_x"], a["max_x"], b["min_x"], b["max_x"])
    gy = gap(a["min_y"], a["max_y"], b["min_y"], b["max_y"])
    return F.sqrt(gx * gx + gy * gy)


def inset(b: Column, by: Column) -> Column:
    return box(b["min_x"] + by, b["min_y"] + by, b["max_x"] - by, b["max_y"] - by)


def is_empty(b: Column) -> Column:
    return (b["min_x"] >= b["max_x"]) | (b["min_y"] >= b["max_y"])


def is_valid(b: Column) -> Column:
    """Finite, ordered, with an inside."""
    finite = reduce(
        lambda x, y: x & y,
        [b[s].isNotNull() & ~F.isnan(b[s]) & (F.abs(b[s]) < F.lit(float("inf"))) for s in SIDES],
    )
    return F.coalesce(finite & ~is_empty(b), F.lit(False))


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x,y>>; the closing point may be repeated or not."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    twice = F.aggregate(
        F.arrays_zip(ring.alias("p"), following.alias("q")),
        F.lit(0.0),
        lambda acc, e: acc + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"],
    )
    return F.abs(twice) / 2


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Crossing parity of a ring with the ray to the right of the point."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        rise = F.when(q["y"] == p["y"], F.lit(None)).otherwise(q["y"] - p["y"])
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / rise
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    hits = F.aggregate(
        F.arrays_zip(ring.alias("p"), following.alias("q")), F.lit(0), lambda acc, e: acc + crosses(e)
    )
    return hits % 2 == 1


def ring_faults(ring: Column) -> Column:
    """True where a ring is open, has too few points, no area, or edges that cross."""
    n = F.size(ring)
    edges = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda i: F.struct(i.alias("i"), F.get(ring, i).alias("p"), F.get(ring, i + 1).alias("q")),
    )

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def cross(e: Column, f: Column) -> Column:
        far = (f["i"] - e["i"] > 1) & ~((e["i"] == 0) & (f["i"] == n - 2))
        proper = (turn(e["p"], e["q"], f["p"]) * turn(e["p"], e["q"], f["q"]) < 0) & (
            turn(f["p"], f["q"], e["p"]) * turn(f["p"], f["q"], e["q"]) < 0
        )
        return far & proper

    crossing = F.exists(edges, lambda e: F.exists(edges, lambda f: cross(e, f)))
    first, last = F.get(ring, F.lit(0)), F.get(ring, n - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.coalesce((n < 4) | ~closed | (ring_area(ring) <= 0) | crossing, F.lit(True))


def pixel_area(transform: Column, factor_x: Column, factor_y: Column) -> Column:
    """Square metres per pixel of an affine (a,b,c,d,e,f)."""
    det = transform[0] * transform[4] - transform[1] * transform[3]
    return F.abs(det) * factor_x * factor_y


def box_json(b: Column) -> Column:
    """GeoJSON polygon text of a box, counter-clockwise from the lower right corner."""
    def pt(x: str, y: str) -> Column:
        return F.concat(F.lit("["), b[x].cast("string"), F.lit(","), b[y].cast("string"), F.lit("]"))

    ring = F.concat_ws(
        ",", pt("max_x", "min_y"), pt("max_x", "max_y"), pt("min_x", "max_y"),
        pt("min_x", "min_y"), pt("max_x", "min_y"),
    )
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
