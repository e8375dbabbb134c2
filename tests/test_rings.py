"""Ring faults against brute force over all pairs of edges, and in the quarantine."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from landshift.operators import rings as R
from landshift.operators import validate as V
from landshift.sources import bindings as B


def plain_fault(points):
    if points is None or any(p is None or not all(v is not None and math.isfinite(v) for v in p) for p in points):
        return "NOT_A_RING"
    pts = [tuple(map(Fraction, p)) for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    edges = list(zip(pts, pts[1:]))
    if len(edges) < 3:
        return "NOT_A_RING"
    if pts[0] != pts[-1]:
        return "OPEN"
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in edges) == 0:
        return "NO_AREA"
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for i, (a, b) in enumerate(edges):
        for j in range(i + 1, len(edges)):
            c, d = edges[j]
            if j == i + 1 or (i == 0 and j == len(edges) - 1):
                u, v = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
                if u[0] * v[1] == u[1] * v[0] and u[0] * v[0] + u[1] * v[1] < 0:
                    return "CROSSING"
            elif all(max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k])) for k in (0, 1)) and \
                    turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                return "CROSSING"
    return None


def table(spark, given):
    rows = [(i, None if r is None else [None if p is None else {"x": p[0], "y": p[1]} for p in r]) for i, r in enumerate(given)]
    return spark.createDataFrame(rows, f"ring_id int, ring {R.RING}")


def circle(n, dent=None):
    pts = [(100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    if dent is not None:
        pts[dent] = (-200.0, -3.0)
    return [*pts, pts[0]]


def test_faults_equal_brute_force(spark):
    rnd = random.Random(2)
    given = [None, [], [(0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)],
             [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 5.0), (0.0, 0.0)], [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)],
             [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, float("nan")), (0.0, 0.0)], [(0.0, 0.0), None, (1.0, 1.0), (0.0, 0.0)],
             [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 0.0), (0.0, 8.0), (0.0, 0.0)], [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (8.0, 4.0), (0.0, 8.0), (0.0, 0.0)]]
    for _ in range(400):  # small whole coordinates: many touches and lines on lines
        n, size = rnd.randint(3, 9), rnd.choice([3, 6, 40])
        r = [(float(rnd.randint(0, size)), float(rnd.randint(0, size))) for _ in range(n)]
        given.append([*r, r[0]])
    given += [circle(300), circle(300, 40)]
    want = {i: f for i, r in enumerate(given) if (f := plain_fault(r))}
    assert {r["ring_id"]: r["fault"] for r in R.ring_faults(table(spark, given), "ring_id").collect()} == want
    assert set(want.values()) == {"NOT_A_RING", "OPEN", "NO_AREA", "CROSSING"} and len(want) < len(given) - 50


def test_cells_of_a_long_ring_hold_few_edges(spark):
    edges = R.ring_edges(table(spark, [circle(5000)]), "ring_id")
    assert R._cells(edges, "ring_id").groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 300


def test_faulty_outlines_are_quarantined(spark):
    tables = B.faulty_tables(spark, "/root/testdata/sf0.001")
    box = F.col("box")
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    plain = [corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"), corner("min_x", "min_y")]
    bow = [plain[0], plain[2], plain[1], plain[3], plain[0]]
    odd = F.col("footprint_id").rlike("[05]$")
    ringed = tables["approved_footprints"].withColumn("ring", F.when(odd, F.array(*bow)).otherwise(F.array(*plain)))
    at = F.lit(B.REFERENCE_TIME).cast("timestamp")
    _, before = V.validate(tables, "b", at)
    kept, after = V.validate({**tables, "approved_footprints": ringed}, "b", at)
    is_print = F.col("original_record_reference").startswith("approved_footprints:")
    bad = after.where(is_print & (F.col("reason_code") == "INVALID_GEOMETRY")).count()
    was = before.where(is_print & (F.col("reason_code") == "INVALID_GEOMETRY") & ~F.col("original_record_reference").rlike("[05]$")).count()
    assert bad == was + ringed.where(odd).count() and kept["approved_footprints"].where(odd).count() == 0
    assert kept["approved_footprints"].count() + after.where(is_print).count() == ringed.count()


def test_short_rings_are_judged_in_their_row(spark):
    given = [circle(n, dent) for n in (R.FEW - 1, R.FEW, R.FEW + 1) for dent in (None, 5)]
    want = {i: "CROSSING" for i, r in enumerate(given) if plain_fault(r)}
    assert {r["ring_id"]: r["fault"] for r in R.ring_faults(table(spark, given), "ring_id").collect()} == want and len(want) == 3
    # two rings of one name, apart from each other both valid
    twice = table(spark, [circle(4), [(x + 9.0, y) for x, y in circle(4)]]).withColumn("ring_id", F.lit(7))
    assert R.ring_faults(twice, "ring_id").count() == 0
