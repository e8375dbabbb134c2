import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.operators import change as D, evaluate as E, raster as R
from landshift.operators.components import connected_components


def frame(spark, mask, name="mask"):
    return spark.createDataFrame(
        [(0, int(r), int(c), int(mask[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])],
        f"raster_id bigint, row int, col int, {name} int")


def brute_components(mask, diagonal=True):
    seen, out = set(), []
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        stack, part = [start], set()
        while stack:
            r, c = stack.pop()
            if (r, c) in part or not (0 <= r < mask.shape[0] and 0 <= c < mask.shape[1]) or not mask[r, c]:
                continue
            part.add((r, c))
            stack += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or abs(a) + abs(b) == 1]
        seen |= part
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_match_flood_fill(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    mask = (rng.random((16, 16)) < 0.45).astype(int)
    got = {}
    for r in R.pixel_components(frame(spark, mask).where("mask = 1"), connectivity=connectivity).collect():
        got.setdefault(r["component"], set()).add((r["row"], r["col"]))
    assert {frozenset(v) for v in got.values()} == brute_components(mask, connectivity == 8)


def test_star_rounds_equal_contraction_at_once(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.randrange(60), rnd.randrange(60)) for _ in range(80)]
    edges = spark.createDataFrame(rows, "g int, src bigint, dst bigint")
    a = connected_components(edges, None, ("g",)).collect()
    b = connected_components(edges, None, ("g",), held=5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        c = connected_components(edges, None, ("g",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, a)) == sorted(map(tuple, c))


def test_hub_and_chain_over_many_tasks(spark):
    """A hub of a third of all edges, a chain through shuffled ids and loose pairs, over 32 tasks that hold 40 edges."""
    ids = random.Random(5).sample(range(1000, 2000), 200)
    edges = [(7, v) for v in range(100, 300)] + list(zip(ids, ids[1:])) + [(v, v + 1) for v in range(3000, 3400, 2)]
    random.Random(6).shuffle(edges)
    given = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(32)
    got = {r["vertex"]: r["component"] for r in connected_components(given, held=40).collect()}
    want = {7: 7, **dict.fromkeys(range(100, 300), 7), **dict.fromkeys(ids, min(ids))}
    assert got == want | {v: v - v % 2 for v in range(3000, 3400)}


def window(a, fn, r):
    h, w = a.shape
    return np.array([[fn(a[max(0, i - r): i + r + 1, max(0, j - r): j + r + 1]) for j in range(w)] for i in range(h)])


def test_open_close_matches_numpy(spark):
    mask = (np.random.default_rng(1).random((16, 16)) < 0.75).astype(int)
    want = window(window(window(window(mask, np.min, 1), np.max, 1), np.max, 1), np.min, 1)
    got = np.zeros_like(mask)
    for r in R.open_close(frame(spark, mask), "mask", 3).collect():
        got[r["row"], r["col"]] = r["mask"]
    assert (got == want).all()


def extents(spark, side=24):
    return spark.createDataFrame([(0, side, side, [2., 0., 100., 0., -2., 200.], 1.0)],
                                 "raster_id bigint, width int, height int, transform array<double>, factor double")


def test_block_outline_area(spark):
    mask = np.zeros((24, 24), int)
    mask[2:6, 3:8] = 1
    r = R.component_footprints(frame(spark, mask).where("mask = 1"), extents(spark)).first()
    assert r["outline_area"] == 12 and r["area_m2"] == 48 and tuple(r["box"]) == (107, 189, 115, 195)


def test_hole_and_island_belong_to_the_outer_shape(spark):
    mask = np.zeros((24, 24), int)
    mask[2:11, 2:11] = 1
    mask[4:9, 4:9] = 0
    mask[6, 6] = 1
    rows = R.component_footprints(frame(spark, mask).where("mask = 1"), extents(spark)).collect()
    assert len(rows) == 1 and rows[0]["filled_pixels"] == 81 and rows[0]["outline_area"] == 64


def pair(spark, score=0.9, area=4.0):
    return spark.createDataFrame([(0, score, True, 0.9, area)], "pair_id bigint, score double, transform_plausible boolean, overlap_ratio double, pixel_area double")


def pair_pixels(spark, old, new):
    return spark.createDataFrame(
        [(0, int(r), int(c), int(old[r, c]), int(new[r, c])) for r in range(old.shape[0]) for c in range(old.shape[1])],
        "pair_id bigint, row int, col int, old_mask int, new_mask int")


def test_mask_addition_removal_gate_and_speck(spark):
    old, new = np.zeros((24, 24), int), np.zeros((24, 24), int)
    old[3:9, 3:9] = new[3:9, 3:9] = 1
    new[15:21, 15:21] = 1
    labels = D.mask_difference(pair_pixels(spark, old, new), pair(spark))
    assert [tuple(r) for r in labels.groupBy("label").count().collect()] == [(1, 36)]
    back = pair_pixels(spark, new, old)
    labels = D.mask_difference(back, pair(spark))
    r = D.changed_area(labels, back, pair(spark)).first()
    assert r["removed_area"] == 144 and r["added_area"] == 0 and r["common_pixels"] == 36
    assert D.mask_difference(back, pair(spark, 0.1)).count() == 0
    speck = old.copy()
    speck[20, 20] = 1
    assert D.mask_difference(pair_pixels(spark, old, speck), pair(spark), {"min_region": 2, "adjacency": 1, "min_score": 0.25}).count() == 0
    grown = old.copy()
    grown[3:9, 9:12] = 1
    assert {r["label"] for r in D.mask_difference(pair_pixels(spark, old, grown), pair(spark)).collect()} == {3}


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 0, 1), (1, 0, 1, 0), (1, 1, 0, 0)], "row int, col int, predicted int, target int").withColumn("k", F.lit(1))
    m = E.mask_metrics(df, ["k"]).first()
    assert (m["iou"], m["f1"], m["precision"], m["recall"]) == (1 / 3, 0.5, 0.5, 0.5)
    assert E.object_recall(df, ("k",), ["k"]).first()["object_recall"] == 1
    empty = df.withColumn("predicted", F.lit(0)).withColumn("target", F.lit(0))
    assert E.mask_metrics(empty, ["k"]).first()["iou"] == 1


def test_training_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (200, 2)) / 4
    t = (x[:, 0] + rng.random(200) * 0.3 > 0.6).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, t)], "x0 double, x1 double, target int")
    got = E.train_logistic(df, 2, epochs=5)
    w, b = np.zeros(2), 0.0
    weight = np.where(t > 0, (t == 0).sum() / t.sum(), 1.0)
    for _ in range(5):
        err = (1 / (1 + np.exp(-(x @ w + b))) - t) * weight
        w, b = w - 0.2 * (x.T @ err) / weight.sum(), b - 0.2 * err.sum() / weight.sum()
    assert np.allclose(got["weights"], w) and abs(got["bias"] - b) < 1e-9


def test_resample_skips_empty_grids(spark):
    from landshift.operators import spatial as S
    grids = spark.createDataFrame(
        [("a", "r", 0.0, 2.0, 1.0, 2, 2, 0.0, 2.0, 1.0), ("b", "r", 0.0, 2.0, 1.0, 2, 0, 0.0, 2.0, 1.0), ("c", "r", 0.0, 2.0, 1.0, -1, 2, 0.0, 2.0, 1.0)],
        "grid_id string, raster_id string, left double, top double, resolution double, grid_width bigint, grid_height bigint, src_left double, src_top double, src_res double")
    px = spark.createDataFrame([("r", i, j, 1.0, True) for i in range(2) for j in range(2)], "raster_id string, row int, col int, value double, valid boolean")
    for method in ("nearest", "bilinear"):
        assert {r["grid_id"]: r["count"] for r in S.resample(px, grids, method).groupBy("grid_id").count().collect()} == {"a": 4}


def test_runs_meet_once_over_stretches(spark):
    ends = spark.createDataFrame(
        [(1, 0, 1, 0, 200), (1, 0, 2, 210, 210), (1, 1, 3, 60, 130), (1, 1, 4, 201, 209), (1, 1, 5, 212, 300)],
        "raster_id int, row int, run long, c0 int, c1 int")
    found = lambda reach: sorted((r[0], r[1]) for r in R.run_pairs(ends, ("raster_id",), reach).select("upper.run", "lower.run").collect())
    assert found(1) == [(1, 3), (1, 4), (2, 4)] and found(0) == [(1, 3)]
