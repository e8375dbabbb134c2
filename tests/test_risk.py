import datetime as dt

import pytest
from pyspark.sql import functions as F

from landshift.functions import boxes as G
from landshift.functions.constants import RISK_THRESHOLDS, RISK_WEIGHTS
from landshift.operators import complaints as C, risk as R, spatial as S, temporal as T

D = dt.date


def boxed(df, *names):
    out = df
    for n in names:
        out = out.withColumn(n, G.box(*[F.col(n)[i] for i in range(4)]))
    return out


def areas(spark, approved, old, new, parcel, setback):
    df = boxed(spark.createDataFrame([(approved, old, new, parcel)], "a array<double>, o array<double>, n array<double>, p array<double>"),
               "a", "o", "n", "p")
    e = S.plan_areas(F.col("a"), F.col("o"), F.col("n"), F.col("p"), F.lit(float(setback)))
    return df.select(*[c.alias(k) for k, c in e.items()]).first()


def test_plan_inside_approval(spark):
    r = areas(spark, [20., 20., 50., 50.], [20., 20., 40., 50.], [20., 20., 50., 50.], [0., 0., 100., 100.], 5)
    assert r["added_area"] == 300 and r["added_outside_approval_area"] == 0 and r["removed_approved_area"] == 0
    assert r["setback_zone_area"] == 0 and r["site_coverage_ratio"] == 0.09


def test_plan_outside_approval_and_road(spark):
    r = areas(spark, [20., 20., 50., 50.], [20., 20., 50., 50.], [20., 20., 60., 50.], [0., 0., 100., 100.], 5)
    assert r["added_outside_approval_area"] == 300
    new = boxed(spark.createDataFrame([("c", [20., 20., 60., 50.], "E")], "k string, b array<double>, crs string"), "b")
    road = boxed(spark.createDataFrame([("road-edge-001", [60., 0., 60., 100.], "E")], "boundary_id string, box array<double>, crs string"), "box")
    assert [x["boundary_id"] for x in S.boundary_hits(new, road, "k", "b").collect()] == ["road-edge-001"]


def test_setback_that_vanishes_takes_the_parcel(spark):
    r = areas(spark, [0., 0., 1., 1.], [0., 0., 1., 1.], [0., 0., 4., 4.], [0., 0., 8., 8.], 4)
    assert r["setback_zone_area"] == 16
    assert areas(spark, [0., 0., 1., 1.], [0., 0., 1., 1.], [0., 0., 4., 4.], [0., 0., 8., 8.], 0)["setback_zone_area"] == 0


def test_runs_of_cells_equal_cells(spark):
    import random

    rnd = random.Random(3)
    shapes = ("approved", "old", "new", "parcel", "inner")
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(shapes), [x := rnd.uniform(-90, 90), y := rnd.uniform(-90, 90), x + rnd.uniform(-1, 60), y + rnd.uniform(-1, 90)])
            for _ in range(60)]
    rows += [("gap", "old", [0., 0., 2., 2.]), ("gap", "new", [5., 0., 9., 2.]), ("gap", "old", [0., 0., 2., 2.])]
    df = boxed(spark.createDataFrame(rows, "k string, src string, box array<double>"), "box")
    cells, runs = S.box_cells(df, "box", 1.5), S.box_cells(df, "box", 1.5, ["k"])
    assert runs.count() < cells.count() / 10
    areas = [{tuple(r) for r in S.plan_comparison_cells(c, ["k"], 1.5).collect()} for c in (cells, runs)]
    assert areas[0] == areas[1] and len(areas[0]) == 4
    union = S.dissolve(cells, ["k"]).groupBy("k").count()
    assert {tuple(r) for r in union.collect()} == {
        tuple(r) for r in S.dissolve(runs, ["k"]).groupBy("k").agg(F.sum(F.col("cx_end") - F.col("cx"))).collect()}


def test_parcel_ambiguity_and_no_match(spark):
    changes = boxed(spark.createDataFrame([("c1", [90., 20., 110., 40.], "E"), ("c2", [300., 20., 310., 30.], "E")],
                                          "change_id string, box array<double>, crs string"), "box")
    parcels = boxed(spark.createDataFrame([("p-b", [100., 0., 200., 100.], "E"), ("p-a", [0., 0., 100., 100.], "E")],
                                          "parcel_id string, box array<double>, crs string"), "box")
    for bucket in (16.0, 128.0):
        m = {r["change_id"]: r for r in S.parcel_match(S.parcel_overlaps(changes, parcels, bucket), changes).collect()}
        assert m["c1"]["matched_parcel_id"] == "p-a" and m["c1"]["overlap_count"] == 2
        assert m["c1"]["boundary_crossing"] and m["c1"]["multiple_parcel_ambiguity"] and m["c1"]["match_percent"] == 50
        assert m["c2"]["no_parcel_match"] and not m["c2"]["boundary_crossing"]


def permits_df(spark, rows):
    return spark.createDataFrame(rows, "permit_id string, parcel_id string, plan_version int, valid_from date, valid_until date")


@pytest.mark.parametrize("rows,status,match", [
    ([("a", "p", 1, D(2023, 1, 1), D(2024, 1, 1))], "expired_at_capture", None),
    ([("a", "p", 1, D(2024, 1, 1), D(2025, 1, 1)), ("b", "p", 1, D(2024, 6, 1), D(2024, 6, 1))], "valid_match", "b"),
    ([("a", "p", 2, D(2024, 1, 1), D(2025, 1, 1))], "wrong_plan_version", None),
    ([("a", "p", 1, D(2025, 1, 1), D(2026, 1, 1))], "not_yet_valid", None),
    ([("a", "q", 1, D(2024, 1, 1), D(2025, 1, 1))], "no_match", None),
])
def test_permit_statuses(spark, rows, status, match):
    changes = spark.createDataFrame([("c", "p", 1, D(2024, 6, 1))], "change_id string, parcel_id string, plan_version int, capture_date date")
    r = T.permit_at_capture(changes, permits_df(spark, rows)).first()
    assert (r["permit_status"], r["matched_permit_id"]) == (status, match)


def test_rule_set_choice(spark):
    rules = spark.createDataFrame(
        [("rules-2024", "m", "z", D(2024, 1, 1), D(2024, 12, 31)), ("rules-2025", "m", "z", D(2025, 1, 1), None),
         ("tie-a", "n", "z", D(2024, 1, 1), None), ("tie-b", "n", "z", D(2024, 1, 1), None)],
        "rule_set_id string, municipality_id string, zone string, effective_from date, effective_until date")
    asked = spark.createDataFrame(
        [("m", "z", D(2024, 6, 1)), ("m", "z", D(2023, 1, 1)), ("n", "z", D(2024, 6, 1)), ("m", "z", D(2024, 12, 31))],
        "municipality_id string, zone string, capture_date date")
    got = {(r["municipality_id"], r["capture_date"]): (r["rule_set_id"], r["rule_error"]) for r in T.rule_in_force(asked, rules).collect()}
    assert got[("m", D(2024, 6, 1))] == ("rules-2024", None) and got[("m", D(2024, 12, 31))] == ("rules-2024", None)
    assert got[("m", D(2023, 1, 1))] == (None, "NO_EFFECTIVE_RULE_SET")
    assert got[("n", D(2024, 6, 1))] == (None, "AMBIGUOUS_RULE_SETS")


def evidence(spark, **changed):
    base = dict(
        change_confidence=0.8, changed_area=300.0, changed_area_reference=100.0, added_outside_approval_area=300.0,
        permit_status="expired_at_capture", boundary_crossing=True, multiple_parcel_ambiguity=False, no_parcel_match=False,
        complaint_groups=0, site_coverage_ratio=0.12, maximum_site_coverage=0.6, setback_zone_area=0.0, boundary_hits=0,
        registration_quality=0.9, evidence_age_days=10, evidence_freshness_days=180)
    base.update(changed)
    df = spark.createDataFrame([tuple(base.values())], list(base))
    return df.withColumn("quality_warnings", F.array().cast("array<string>")).withColumn(
        "weights", F.struct(*[F.lit(v).alias(k) for k, v in RISK_WEIGHTS.items()])).withColumn(
        "thresholds", F.struct(*[F.lit(v).alias(k) for k, v in RISK_THRESHOLDS.items()]))


def test_risk_factors_and_level(spark):
    r = R.risk_scores(evidence(spark)).first()
    points = {f["code"]: f["points"] for f in r["factors"]}
    assert points["UNAPPROVED_ADDED_AREA"] == 35 and points["ACTIVE_PERMIT_NOT_FOUND"] == 20
    assert points["PARCEL_BOUNDARY_REVIEW"] == 15 and r["score"] == 96 and r["level"] == "CRITICAL_REVIEW"
    assert [f["code"] for f in r["factors"]] == [
        "CHANGE_CONFIDENCE", "CHANGED_AREA", "UNAPPROVED_ADDED_AREA", "ACTIVE_PERMIT_NOT_FOUND", "PARCEL_BOUNDARY_REVIEW"]


def test_risk_edges(spark):
    r = R.risk_scores(evidence(
        spark, change_confidence=0.0, changed_area=0.0, added_outside_approval_area=0.0, permit_status="wrong_plan_version",
        boundary_crossing=False, registration_quality=0.8, evidence_age_days=180)).first()
    assert [f["code"] for f in r["factors"]] == ["WRONG_PLAN_VERSION"] and r["level"] == "LOW"


def complaints_df(spark, rows):
    df = spark.createDataFrame(rows, "ordinal bigint, complaint_id string, parcel_id string, x double, y double, received_at timestamp, description string, media_sha256 string, perceptual_hash string")
    return df


T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def groups(spark, rows):
    c = complaints_df(spark, rows)
    links = C.complaint_links(c)
    m = C.complaint_membership(c, links)
    return C.complaint_groups(m, links).collect(), C.group_ids(m).collect()


def test_duplicate_complaints_by_media(spark):
    g, ids = groups(spark, [(0, "c1", "p", 0., 0., T0, "", "m" * 64, None), (1, "c2", "p", 1., 0., T0 + 2 * H, "", "m" * 64, None)])
    assert len(g) == 1 and g[0]["members"] == 2 and "MEDIA_HASH" in g[0]["duplicate_signals"]
    import hashlib
    assert ids[0]["group_id"] == "complaint-group-" + hashlib.sha256(b"c1|c2").hexdigest()[:16]


def test_distinct_complaints_and_fuzzy_text(spark):
    g, _ = groups(spark, [(0, "c1", "p", 0., 0., T0, "new floor being added", "a" * 64, None), (1, "c2", "p", 1., 0., T0, "broken road lamp", "b" * 64, None)])
    assert len(g) == 2
    g, _ = groups(spark, [(0, "c1", "p", 0., 0., T0, "New  floor being added", None, None), (1, "c2", "p", 1., 0., T0, "new floor is being added", None, None)])
    assert len(g) == 1 and g[0]["duplicate_signals"] == ["SAME_PARCEL", "SPATIAL_PROXIMITY", "TEXT_SIMILARITY", "TIME_WINDOW"]


def test_links_equal_brute_force_on_a_crowded_parcel(spark):
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    words = ["wall built", "wall builds", "roof raised", "roof raises up", "noise"]
    rows = [(i, f"c{i:03d}", "p", rnd.uniform(0, 70), rnd.uniform(0, 70), T0 + rnd.uniform(0, 500) * H, rnd.choice(words),
             rnd.choice(["a", "b", None]), f"{rnd.getrandbits(12):016x}") for i in range(120)]
    parent = list(range(120))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(120):
        for j in range(i + 1, 120):
            a, b = rows[i], rows[j]
            if abs((a[5] - b[5]).total_seconds()) > 7 * 86400 or ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5 > 25:
                continue
            if (SequenceMatcher(None, a[6], b[6]).ratio() >= 0.82 or (a[7] and a[7] == b[7])
                    or (int(a[8], 16) ^ int(b[8], 16)).bit_count() <= 6):
                parent[find(i)] = find(j)
    want = sorted(sorted(f"c{i:03d}" for i in range(120) if find(i) == r) for r in set(map(find, range(120))))
    c = complaints_df(spark, rows)
    m = C.complaint_membership(c, C.complaint_links(c)).select("group_root", "complaint_id").collect()
    got = {}
    for r in m:
        got.setdefault(r["group_root"], []).append(r["complaint_id"])
    assert sorted(sorted(v) for v in got.values()) == want


def test_links_of_few_and_crowded_parcels_group_alike(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, f"c{i:03d}", f"p{i % 9}" if i % 4 else "crowd", rnd.uniform(0, 60), rnd.uniform(0, 60), T0 + rnd.uniform(0, 500) * H,
             rnd.choice(["wall built", "wall builds", "roof raised", "noise", None]), rnd.choice(["a", "b", None]), f"{rnd.getrandbits(12):016x}")
            for i in range(160)]
    rows += [(900, "odd", "p1", None, 5., T0, "noise", "a", None), (901, "even", "p1", 5., 5., None, "noise", "a", None)]
    c = complaints_df(spark, [*rows, *rows[:20]])

    def found(few):
        links = C.complaint_links(c, few=few)
        m = C.complaint_membership(c, links)
        members = sorted((r["parcel_id"], r["complaint_id"], r["group_root"]) for r in m.collect())
        return members, sorted((r["group_root"], r["duplicate_signals"]) for r in C.complaint_groups(m, links).collect())

    want = found(0)
    assert found(30) == want and found(1000) == want and len(want[0]) == 182


def test_few_complaints_of_many_parcels_are_not_laid_out_by_bands(spark, monkeypatch):
    def refuse(*_args, **_kw):
        raise AssertionError("bands are for crowded parcels")

    monkeypatch.setattr(C, "near_links", refuse)
    rows = [(i, f"c{i}", f"p{i // 4}", float(i % 4), 0., T0, "noise", None, "0f" * 8) for i in range(40)]
    assert C.complaint_links(complaints_df(spark, rows)).count() == 10 * 6 * 2


def test_changes_without_keys_keep_their_rows(spark):
    import datetime as dt

    from landshift.operators import temporal as T
    day = dt.date(2024, 5, 1)
    changes = spark.createDataFrame(
        [("a", "p", 1, day), ("b", None, 1, day), ("c", "p", None, day), ("d", "p", 1, None), ("e", "q", 1, day)],
        "change_id string, parcel_id string, plan_version int, capture_date date")
    permits = spark.createDataFrame([("m", "p", 1, dt.date(2024, 1, 1), dt.date(2024, 12, 31))],
                                    "permit_id string, parcel_id string, plan_version int, valid_from date, valid_until date")
    got = {r["change_id"]: r["permit_status"] for r in T.permit_at_capture(changes, permits).collect()}
    assert got == {"a": "valid_match", "b": "no_match", "c": "wrong_plan_version", "d": "no_match", "e": "no_match"}


def test_box_links_of_all_sizes_equal_brute_force(spark):
    import numpy as np

    from landshift.operators.components import connected_components
    from landshift.operators.nearby import box_links
    rng = np.random.default_rng(12)
    rows = []
    for i in range(250):
        w, h = 10.0 ** rng.uniform(-1, 3.7, 2) if i % 5 else (0.0, 0.0)
        x, y = rng.uniform(-2e4, 2e4, 2)
        rows.append((i, (x, y, x + w, y + h)))
    near = lambda p, q: np.hypot(max(0, p[0] - q[2], q[0] - p[2]), max(0, p[1] - q[3], q[1] - p[3])) <= 5.0
    root = list(range(250))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, p in rows:
        for j, q in rows[:i]:
            if near(p, q):
                root[max(find(i), find(j))] = min(find(i), find(j))
    boxes = spark.createDataFrame(
        [(i, dict(zip(("min_x", "min_y", "max_x", "max_y"), map(float, b)))) for i, b in rows],
        "id long, box struct<min_x: double, min_y: double, max_x: double, max_y: double>")
    links = box_links(boxes, 5.0)
    assert all(near(dict(rows)[r["src"]], dict(rows)[r["dst"]]) for r in links.collect())
    got = {r["vertex"]: r["component"] for r in connected_components(links, boxes.select(boxes.id.alias("vertex"))).collect()}
    assert got == {i: find(i) for i in range(250)} and len(set(got.values())) < 245


def test_wide_changes_are_stored_with_their_hits_and_rules_stand_alone(spark, monkeypatch):
    from landshift.plans import assess as A

    stored = []

    def keep(df):
        stored.append(set(df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(A, "cut_lineage", keep)
    box = lambda *v: "named_struct(" + ", ".join(f"'{n}', {x}D" for n, x in zip(G.SIDES, v)) + ")"
    changes = spark.sql(" union all ".join(
        f"""select '{c}' change_id, 'p' parcel_id, date'2024-05-01' capture_date, timestamp'2024-05-01' capture_time, 1 plan_version,
        {box(x, 10, x + 20, 30)} box, {box(10, 10, 20, 20)} old_box, {box(x, 10, x + 20, 30)} new_box, 0.9D change_confidence,
        0.9D registration_quality, array('w') quality_warnings, timestamp'2024-05-09' evaluation_time, 'E' crs""" for c, x in (("near", 10), ("far", 500))))
    parcels = spark.sql(f"select 'p' parcel_id, 'w' ward_id, 'm' municipality_id, 'z' zone, {box(0, 0, 90, 90)} box, 'E' crs")
    plans = spark.sql(f"select 1 ordinal, 'f' footprint_id, 'p' parcel_id, 1 plan_version, {box(10, 10, 30, 30)} box")
    roads = spark.sql(f"select 'a' boundary_id, {box(15, 0, 15, 90)} box, 'E' crs union all select 'b', {box(25, 0, 25, 90)}, 'E'")
    struct = lambda d: "named_struct(" + ", ".join(f"'{k}', {float(v)}D" for k, v in d.items()) + ")"
    rules = spark.sql(f"""select 'r' rule_set_id, 'm' municipality_id, 'z' zone, date'2024-01-01' effective_from, cast(null as date) effective_until,
        0.5D maximum_site_coverage, 5D setback_metres, 100D changed_area_reference, 180 evidence_freshness_days,
        {struct(RISK_THRESHOLDS)} thresholds, {struct(RISK_WEIGHTS)} weights""")
    permits = permits_df(spark, [("t", "p", 1, D(2024, 1, 1), D(2024, 12, 31))])
    counts = spark.createDataFrame([("p", 2)], "parcel_id string, complaint_groups bigint")
    got = {r["change_id"]: r for r in A.assemble_evidence(changes, parcels, plans, permits, rules, roads, counts).collect()}
    assert got["near"]["boundary_hits"] == 2 and got["near"]["rule_set_id"] == "r" and got["near"]["permit_status"] == "valid_match"
    assert got["far"]["boundary_hits"] == 0 and got["far"]["link_error"] == "NO_PARCEL_MATCH"
    assert any({"change_id", "boundary_hits"} <= c for c in stored)
    assert {"municipality_id", "zone", "capture_date", "rule_set_id", "rule_error"} in stored


def test_catalogue_on_disk_feeds_the_assessment(spark, tmp_path):
    from landshift.plans.assess import assess_catalogue, no_polygon_results
    from landshift.sources import bindings as B, catalogue as K
    root = "/root/testdata/sf0.001"
    hot = B.changes(spark, root).where("parcel_id in ('parcel-1', 'parcel-2', 'parcel-4')").limit(40)
    far = hot.limit(20).withColumn("change_id", F.concat(F.lit("far-"), "change_id")).withColumn(
        "box", F.col("box").withField("min_x", F.lit(9e6)).withField("max_x", F.lit(9e6 + 5)))
    tables = {"changes": hot.unionByName(far), "complaints": B.complaints(spark, root).limit(50)}
    tables |= {n: getattr(B, n)(spark, root) for n in ("parcels", "approved_footprints", "permits", "rule_sets", "public_boundaries")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    done = assess_catalogue(spark, str(tmp_path)).collect()
    assert len(done) == tables["changes"].count() == len({r["change_id"] for r in done})
    assert {r["error_code"] for r in done if r["change_id"].startswith("far-")} == {"NO_PARCEL_MATCH"}
    assert any(r["score"] is not None for r in done)
    tables["parcels"].drop("zone").write.mode("overwrite").parquet(str(tmp_path / "parcels.parquet"))
    with pytest.raises(K.SchemaMismatch):
        assess_catalogue(spark, str(tmp_path))
    pairs = spark.createDataFrame([("a",), ("b",)], "pair_id string")
    none = no_polygon_results(pairs, pairs.where("pair_id = 'a'")).collect()
    assert [(r["pair_id"], r["level"], r["case_id"]) for r in none] == [("b", "LOW", None)]


def test_permit_steps_equal_brute_force_and_changes_are_read_once(spark, tmp_path):
    import random

    pick = random.Random(3)
    base = D(2023, 1, 1).toordinal()

    def day(spread):
        return None if pick.random() < 0.05 else D.fromordinal(base + pick.randrange(spread))

    permits, changes = [], []
    for i in range(400):
        start = day(900)
        end = D.fromordinal(start.toordinal() + pick.choice((-1, 0, 1, 30, 90, 300, 700))) if start else day(900)
        permits.append((f"m{i % 390}", pick.choice(("p", "p", "q", "r", "s", None)), pick.choice((1, 2, 2, None)), start, end))
    for i in range(900):
        changes.append((f"c{i}", pick.choice(("p", "q", "r", "s", "t", None)), pick.choice((1, 2, 3, None)), day(1700)))
    permits += [("x", "bad", 1, D(2024, 1, 2), D(2024, 1, 1)), ("old", "far", 1, D(1969, 12, 30), D(1970, 1, 2))]
    changes += [("bad", "bad", 1, D(2024, 1, 1)), ("bad0", "bad", 1, None), ("far", "far", 1, D(1970, 1, 2)), ("far3", "far", 1, D(1970, 1, 3))]
    changes += changes[:5]

    def expected(parcel, version, date):
        mine = [p for p in permits if parcel is not None and p[1] == parcel]
        over = [p for p in mine if date and p[3] and p[4] and p[3] <= date <= p[4]]
        same = [p for p in over if version is not None and p[2] == version]
        best = max(same, key=lambda p: (p[3], p[0]), default=None)
        ends = [p[4] for p in mine if p[4]]
        status = ("no_match" if not mine or date is None else "valid_match" if same else "wrong_plan_version" if over
                  else "expired_at_capture" if ends and min(ends) < date else "not_yet_valid")
        return status, best and best[0], best and best[3], len(mine)

    spark.createDataFrame(changes, "change_id string, parcel_id string, plan_version int, capture_date date").write.parquet(f"{tmp_path}/c")
    out = T.permit_at_capture(spark.read.parquet(f"{tmp_path}/c"), permits_df(spark, permits))
    assert out.columns == ["parcel_id", "plan_version", "capture_date", "change_id", "permit_status", "matched_permit_id",
                           "matched_valid_from", "candidate_count"]
    got = sorted((r["change_id"], r["permit_status"], r["matched_permit_id"], r["matched_valid_from"], r["candidate_count"]) for r in out.collect())
    assert got == sorted((c, *expected(*key)) for c, *key in changes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def box_of(rnd, place, size):
    x, y = rnd.uniform(-place, place), rnd.uniform(-place, place)
    return [x, y, x + rnd.choice((0.0, 1.0, rnd.uniform(1, size))), y + rnd.uniform(1, size)]


def test_changes_look_up_their_parcel_as_the_join_and_the_grouping_find_it(spark):
    import random

    from landshift.plans import assess as A

    rnd = random.Random(8)
    crs = lambda: rnd.choice(("E", "E", "E", "E", "F", None))
    land = [(f"p{i}", box_of(rnd, 900, rnd.choice((40, 90, 700))), crs()) for i in range(150)]
    land += [(f"p{i}", box_of(rnd, 900, 90), "E") for i in (3, 4)] + [(None, box_of(rnd, 900, 90), "E"), ("n", [0.0, None, 5.0, 5.0], "E")]
    land += [("edge", [128.0, 128.0, 192.0, 192.0], "E")] + [(f"heap{i}", [2000.0, 2000.0, 2050.0, 2050.0 + i % 3], "E") for i in range(30)]
    rows = [(f"c{i}", box_of(rnd, 900, rnd.choice((8, 64, 65, 130, 2000))), crs()) for i in range(400)]
    rows += rows[:4] + [(f"c{i}", box_of(rnd, 900, 90), "E") for i in (7, 8)] + [("far", [5e12, 0.0, 5e12 + 5, 9.0], "E"), ("gap", [None, 0.0, 1.0, 9.0], "E")]
    rows += [("touch", [64.0, 64.0, 128.0, 128.0], "E"), ("in", [127.5, 127.5, 128.5, 128.5], "E"), ("none", None, "E")]
    rows += [(f"heap{i}", [2001.0, 2001.0, 2010.0, 2060.0], "E") for i in range(3)]
    schema = "{} string, box array<double>, crs string"
    changes = boxed(spark.createDataFrame(rows, schema.format("change_id")), "box")
    land = boxed(spark.createDataFrame(land, schema.format("parcel_id")), "box").select(
        "*", F.length("parcel_id").alias("municipality_id"), F.lit("w").alias("ward_id"), F.lit("z").alias("zone"),
        F.lit(1).alias("approved_plan_version"), F.col("box").alias("approved_box"), F.lit(2).alias("complaint_groups"))
    levels = sorted({r[0] for r in changes.select(S.lookup_level(F.col("box"))).collect()} - {None})
    assert len(levels) > 3
    cols = ("change_id", "matched_parcel_id", "parcel_box", "municipality_id", *A.FLAGS)

    def bag(df):
        return sorted(df.select(*cols).collect(), key=str)

    want = bag(A._matched_in_general(changes, land))
    assert sum(r["matched_parcel_id"] is not None for r in want) > 100
    for few in (5, 1000):
        assert bag(A.matched_changes(changes, land, levels, 1, few)) == want
    once = changes.where("change_id like 'c1%'")
    for hint in (False, True):
        cells = S.lookup_cells(land.where("parcel_id is not null"), levels)
        found = S.look_up_parcels(S.lookup_home(once, "box"), "box", cells, hint)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "rightHint=(strategy=merge)" in plan or not hint
        assert sorted((r["change_id"], r["no_parcel_match"]) for r in found.collect()) == sorted(
            (r["change_id"], r["no_parcel_match"]) for r in S.parcel_match(S.parcel_overlaps(once, land.where("parcel_id is not null")), once).collect())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files_and_can_be_discarded(spark):
    import os
    import time

    from landshift.session import RELEASE, configured, discard, store

    before, was = shuffle_files(spark), spark.conf.get(RELEASE[0])
    rows, seen = store(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), n=F.count(F.lit(1)))
    assert seen["n"] == rows.count() == 700 and spark.conf.get(RELEASE[0]) == was
    for _ in range(50):
        if shuffled := {f for f in shuffle_files(spark) - before if f.endswith(".data")}:
            time.sleep(0.2)
    # Only the count above may have left one.
    assert len(shuffled) <= 1
    folder = os.path.dirname(rows.inputFiles()[0].removeprefix("file:"))
    other = spark.createDataFrame([(1,)], "a int")
    discard(other.localCheckpoint())
    assert os.path.isdir(folder)
    discard(rows)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError), configured(spark, *RELEASE):
        raise ValueError
    assert spark.conf.get(RELEASE[0]) == was


def test_rank_adds_one_number_a_partition_without_a_window_over_the_rows(spark):
    import random

    from landshift.operators.ranking import global_rank

    rnd = random.Random(4)
    rows = [(rnd.choice((None, 1.5, 2.0, 7.25)), f"k{rnd.randrange(300)}") for _ in range(2000)]
    df = spark.createDataFrame(rows, "score double, k string").repartition(7)
    out = global_rank(df, [F.col("score").desc(), F.col("k").asc()], "place")
    got = sorted(out.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 2001))
    assert [(r["score"], r["k"]) for r in got] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_score_reads_the_number_of_warnings_and_null_points_give_none(spark):
    rows = evidence(spark).withColumn("quality_warnings", F.array(F.lit("a"), F.lit("b")))
    counted = rows.withColumn("warning_count", F.size("quality_warnings"))
    assert R.risk_scores(rows).first()["score"] == R.risk_scores(counted).first()["score"] == 86
    plan = R.risk_scores(counted).select("score", "level")._jdf.queryExecution().optimizedPlan().toString()
    assert "quality_warnings" not in plan.split("LogicalRDD")[0] and "format_string" not in plan
    assert R.risk_scores(rows.withColumn("changed_area_reference", F.lit(None).cast("double"))).first()["score"] == 86
    gone = R.risk_scores(rows.withColumn("change_confidence", F.lit(None).cast("double"))).first()
    assert gone["score"] == 70


def test_assessment_meets_stored_permit_steps_in_one_join_of_its_changes(spark):
    from landshift.plans.risk_queries import _tables
    from landshift.plans.assess import assess_changes

    done = assess_changes(_tables(spark, "/root/testdata/sf0.001")).select("case_id", "score", "level")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    # Steps, rules of the day, the rule's setback and its other columns.
    assert plan.count("Join ") == 4 and "Aggregate" not in plan
