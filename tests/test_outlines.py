"""Outline form of the plan comparison against cells one by one, and against the box form."""

import random

from pyspark.sql import functions as F

from landshift.functions import boxes as G
from landshift.operators import outlines as U
from landshift.operators import spatial as S

COLUMNS = ("approved_area", "old_area", "new_area", "added_area", "added_outside_approval_area", "removed_approved_area", "setback_zone_area", "site_coverage_ratio")


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def plain(shapes, setback, size=60):
    cells = {s: {(x, y) for x in range(size) for y in range(size) if inside(r, x + 0.5, y + 0.5)} for s, r in shapes.items()}
    a, o, n, p = (cells.get(s, set()) for s in U.SHAPES)
    disc = [(dx, dy) for dx in range(-setback, setback + 1) for dy in range(-setback, setback + 1) if dx * dx + dy * dy <= setback * setback]
    inner = {(x, y) for x, y in p if all((x + dx, y + dy) in p for dx, dy in disc)}
    return (len(a), len(o), len(n), len(n - o), len(n - o - a), len((a & o) - n), len((n & p) - inner), len(n & p) / len(p) if p else 0.0)


def table(spark, cases):
    rows = [(i, s, [{"x": float(x), "y": float(y)} for x, y in r], float(setback)) for i, (shapes, setback) in enumerate(cases) for s, rings in shapes.items() for r in rings]
    return spark.createDataFrame(rows, "case_id int, src string, ring array<struct<x:double,y:double>>, setback_m double")


def rectangle(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def test_outlines_equal_cells_one_by_one(spark):
    rnd = random.Random(6)
    cases = []
    for _ in range(25):
        shapes = {}
        for s in U.SHAPES:
            r = [(rnd.uniform(3, 57), rnd.uniform(3, 57)) for _ in range(rnd.randint(3, 7))]
            shapes[s] = [[*r, r[0]]]
            if rnd.random() < 0.5:  # a hole, or another part
                h = [(rnd.uniform(10, 50), rnd.uniform(10, 50)) for _ in range(3)]
                shapes[s].append([*h, h[0]])
        cases.append((shapes, rnd.randint(0, 4)))
    cases.append(({"new": [rectangle(2, 2, 9, 9)], "parcel": [rectangle(0, 0, 10, 10)]}, 6))  # no inside left: all of it is setback
    cases.append(({"new": [rectangle(2, 2, 9, 9)]}, 1))
    got = {r["case_id"]: tuple(r[c] for c in COLUMNS) for r in U.plan_comparison_outlines(table(spark, cases), ["case_id"], 1.0).collect()}
    assert got == {i: plain(*c) for i, c in enumerate(cases)}


def test_outlines_equal_the_box_form_on_boxes(spark):
    rnd = random.Random(8)
    span = lambda: sorted(rnd.sample(range(60), 2))
    given = []
    for _ in range(60):
        boxes = {s: (lambda x, y: (x[0], y[0], x[1], y[1]))(span(), span()) for s in U.SHAPES}
        given.append((boxes, rnd.randint(0, 6)))
    cases = [({s: [rectangle(*b)] for s, b in boxes.items()}, k) for boxes, k in given]
    got = {r["case_id"]: tuple(round(r[c], 9) for c in COLUMNS) for r in U.plan_comparison_outlines(table(spark, cases), ["case_id"], 1.0).collect()}
    side = ", ".join(f"{s} array<double>" for s in U.SHAPES)
    df = spark.createDataFrame([(i, *[[float(v) for v in b[s]] for s in U.SHAPES], float(k)) for i, (b, k) in enumerate(given)], f"case_id int, {side}, setback double")
    box = {s: G.box(*[F.col(s)[i] for i in range(4)]) for s in U.SHAPES}
    areas = S.plan_areas(*[box[s] for s in U.SHAPES], F.col("setback"))
    want = {r["case_id"]: tuple(round(r[c], 9) for c in COLUMNS) for r in df.select("case_id", *[areas[c].alias(c) for c in COLUMNS]).collect()}
    assert got == want


def test_tall_outlines_meet_over_bands_of_rows(spark):
    rnd = random.Random(11)
    cases = []
    for k in (0, 3, 20):  # a wide disc reaches over more than one step of rows
        shapes = {s: [[*r, r[0]]] for s in U.SHAPES for r in [[(rnd.uniform(3, 147), rnd.uniform(3, 147)) for _ in range(4)]]}
        shapes["parcel"] = [rectangle(5, 5, 146, 140), rectangle(60, 62, 70, 66)]
        cases.append((shapes, k))
    got = {r["case_id"]: tuple(r[c] for c in COLUMNS) for r in U.plan_comparison_outlines(table(spark, cases), ["case_id"], 1.0).collect()}
    assert got == {i: plain(*c, size=150) for i, c in enumerate(cases)}


def test_parcels_without_their_setback_are_few_boxes(spark):
    given = table(spark, [({"parcel": [rectangle(0, 0, 300, 400)]}, 6), ({"parcel": [rectangle(0, 0, 11, 400)]}, 6)])
    rows = U.inset_boxes(given, ["case_id"], 1.0).collect()
    assert sum((r["last"] - r["first"] + 1) * (r["high"] - r["low"]) for r in rows) == 288 * 388
    assert len(rows) <= 400 // U.BAND_ROWS + 1 and {r["case_id"] for r in rows} == {0}
