import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from landshift.functions import boxes as G
from landshift.operators import cases as L, curate as U, registration as M, validate as V
from landshift.sources import bindings as B, catalogue as K

ROOT = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def actions(spark, *steps):
    rows = [("case", i, T0 + dt.timedelta(hours=i), actor, role, kind, target, "insp-1", True, "because") for i, (kind, target, actor, role) in enumerate(steps)]
    return spark.createDataFrame(rows, "case_id string, seq bigint, ts timestamp, actor_id string, actor_role string, action string, "
                                       "target string, inspector_id string, inspector_active boolean, reason string")


SUP = ("boss", "supervisor")
INS = ("insp-1", "inspector")


def run(spark, *steps):
    return sorted(L.judge_actions(actions(spark, *steps)).collect(), key=lambda r: r["seq"])


def test_workflow_cycle(spark):
    r = run(spark, ("create", "", *SUP), ("transition", "CLOSED", *SUP), ("transition", "TRIAGED", *SUP), ("assign", "", *SUP),
            ("transition", "UNDER_REVIEW", *INS), ("note", "", "insp-9", "inspector"), ("unassign", "", *SUP))
    assert [x["error_code"] for x in r] == [None, "INVALID_TRANSITION", None, None, None, "NOT_ASSIGNED_INSPECTOR", None]
    assert [x["after_status"] for x in r] == ["CREATED", "CREATED", "TRIAGED", "ASSIGNED", "UNDER_REVIEW", "UNDER_REVIEW", "TRIAGED"]
    assert r[-1]["after_inspector"] is None


def test_batches_do_not_change_the_result(spark):
    log = B.case_actions(spark, ROOT)
    a = sorted(map(str, L.judge_actions(log).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert a == sorted(map(str, L.judge_actions(log).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_any_sequence_numbers_keep_every_event(spark):
    seqs = [None, -7, -1, 0, 3, 10**15]
    rows = [("c", q, f"{i:064x}") for i, q in enumerate(seqs)] + [(None, 1, "f" * 64), (None, 2, "e" * 64)]
    events = spark.createDataFrame(rows, "case_id string, seq bigint, body_sha256 string")
    got = L.build_chain(events).collect()
    assert len(got) == len(rows)
    of = {(r["case_id"], r["seq"]): r for r in got}
    for before, after in zip(seqs, seqs[1:]):
        assert of["c", after]["previous_hash"] == of["c", before]["event_hash"]
    assert of["c", None]["previous_hash"] is None and of[None, 1]["previous_hash"] is None
    assert of[None, 2]["previous_hash"] == of[None, 1]["event_hash"]


def test_chain_verifies_and_breaks(spark):
    events = spark.createDataFrame([("c", i, f"{i:064x}") for i in range(6)], "case_id string, seq bigint, body_sha256 string")
    chain = L.build_chain(events)
    assert L.verify_chain(chain).first()["first_broken"] is None
    bad = chain.withColumn("body_sha256", F.when(F.col("seq") == 3, "x").otherwise(F.col("body_sha256")))
    assert L.verify_chain(bad).first()["first_broken"] == 3
    assert L.verify_chain(chain.where("seq <> 2")).first()["first_broken"] == 3


def test_lineage_cycle(spark):
    e = spark.createDataFrame([("c", "a", None), ("c", "b", "a"), ("c", "d", "b"), ("c", "x", "y"), ("c", "y", "x")],
                              "case_id string, asset_id string, source_asset_id string")
    got = {r["asset_id"]: (r["level"], r["in_cycle"]) for r in L.lineage_levels(e).collect()}
    assert got == {"a": (0, False), "b": (1, False), "d": (2, False), "x": (None, True), "y": (None, True)}


def test_repeated_ids_have_one_level(spark):
    e = spark.createDataFrame([("c", 0, "a", None), ("c", 1, "b", "a"), ("c", 2, "b", "a"), ("c", 3, "a", None), ("c", 4, "d", "b"), ("c", 5, "d", "b")],
                              "case_id string, position int, asset_id string, source_asset_id string")
    got = sorted(tuple(r) for r in L.lineage_levels(e).collect())
    assert got == [("c", "a", 0, False), ("c", "b", 1, False), ("c", "d", 2, False)]


def test_custody_keeps_assets_without_hash_or_id(spark):
    e = spark.createDataFrame(
        [("c", 0, "a", None, None, None), ("c", 1, "b", None, None, None), ("c", 2, None, "h", None, None), (None, 3, "a", "h", None, None), ("c", 4, "d", "h", None, None)],
        "case_id string, position int, asset_id string, content_sha256 string, original_sha256 string, source_asset_id string")
    got = {r["position"]: r["custody_error"] for r in L.custody_report(e).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "DUPLICATE_CONTENT"}


def test_faults_in_keys_conserve_records(spark):
    tables = dict(B.faulty_tables(spark, ROOT))
    assets, parcels = tables["imagery_assets"], tables["parcels"]
    tables["imagery_assets"] = assets.withColumn(
        "content_sha256", F.when(F.col("ordinal") % 5 != 0, F.col("content_sha256")))
    tables["parcels"] = parcels.unionByName(parcels)
    kept, quarantine = V.validate(tables, "b", F.lit(B.REFERENCE_TIME).cast("timestamp"))
    rejected = {r["e"]: r["n"] for r in quarantine.groupBy(F.split_part("original_record_reference", F.lit(":"), F.lit(1)).alias("e")).agg(F.count("*").alias("n")).collect()}
    for name, df in tables.items():
        assert df.count() - kept[name].count() == rejected.get(name, 0), name


def test_file_hashes_read_in_blocks(spark, tmp_path):
    for name, body in (("a.bin", b"a"), ("b.bin", b"x" * 3_000_001)):
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rpartition("/")[2]: (r["length"], r["content_sha256"]) for r in K.file_hashes(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"a"), ("b.bin", b"x" * 3_000_001))}


def test_quarantine_conserves_records(spark):
    tables = B.faulty_tables(spark, ROOT)
    kept, quarantine = V.validate(tables, "b", F.lit(B.REFERENCE_TIME).cast("timestamp"))
    rejected = {r["e"]: r["n"] for r in quarantine.groupBy(F.split_part("original_record_reference", F.lit(":"), F.lit(1)).alias("e")).agg(F.count("*").alias("n")).collect()}
    for name, df in tables.items():
        assert df.count() - kept[name].count() == rejected.get(name, 0), name
    assert quarantine.select("original_record_reference").distinct().count() == quarantine.count()


def test_catalogue_round_trip(spark, tmp_path):
    fp = B.approved_footprints(spark, ROOT).drop("ordinal")
    quarantine = spark.createDataFrame([], K.schema_of("quarantine"))
    K.write_catalogue({"approved_footprints": fp}, quarantine, str(tmp_path))
    stored = K.load_table(spark, str(tmp_path), "approved_footprints")
    digest = lambda df: K.manifest({"approved_footprints": df}, quarantine).first()
    assert digest(stored) == digest(fp) and K.load_table(spark, str(tmp_path), "quarantine").count() == 0
    fp.withColumn("extra", F.lit(1)).write.mode("overwrite").parquet(str(tmp_path / "approved_footprints.parquet"))
    with pytest.raises(K.SchemaMismatch):
        K.load_table(spark, str(tmp_path), "approved_footprints")


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert K.file_hashes(spark, str(tmp_path / "*.bin")).first()["content_sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_affine_recovers_translation_and_rejects_a_line(spark):
    pts = [(1, float(x), float(y), x + 3.5, y - 2.0) for x, y in ((0, 0), (10, 0), (0, 10), (7, 3))]
    pts += [(2, float(i), float(i), float(i), float(i)) for i in range(5)]
    f = {r["pair_id"]: r for r in M.fit_affine(spark.createDataFrame(pts, "pair_id int, after_x double, after_y double, before_x double, before_y double")).collect()}
    assert abs(f[1]["c"] - 3.5) < 1e-9 and abs(f[1]["f"] + 2) < 1e-9 and f[1]["error_code"] is None
    assert f[2]["error_code"] == "DEGENERATE_POINTS"


def test_leakage_is_reported_and_splits_do_not_leak(spark):
    rows = [("t1", "r1", [0., 0., 10., 10.], "train"), ("t2", "r2", [8., 0., 18., 10.], "test"), ("t3", "r3", [50., 0., 60., 10.], "test")]
    df = spark.createDataFrame(rows, "id string, region_group string, b array<double>, split string").selectExpr(
        "id", "region_group", "split", "named_struct('min_x', b[0], 'min_y', b[1], 'max_x', b[2], 'max_y', b[3]) as box")
    assert [(r["group_id"], r["error_code"]) for r in U.split_leakage(df).collect()] == [("t1", "SPLIT_LEAKAGE")]
    assert U.split_leakage(U.geographic_splits(df.drop("split")).drop("group_id")).count() == 0


def test_case_stream_over_two_triggers_equals_the_fold(spark, tmp_path):
    from landshift.streaming import streams as T
    log = [("create", "", *SUP), ("transition", "TRIAGED", *SUP), ("assign", "", *SUP), ("transition", "UNDER_REVIEW", *INS), ("note", "", *INS)]
    whole = actions(spark, *log)
    cols = [c.split()[0] for c in T.ACTION_COLUMNS.split(", ")]
    whole.where("seq < 3").select(*cols).coalesce(1).write.parquet(str(tmp_path / "in"))
    late = whole.where("seq = 1")
    whole.where("seq >= 3").unionByName(late).select(*cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(whole.select(*cols).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = (T.case_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    judged = spark.read.parquet(str(tmp_path / "out"))
    want = {r["seq"]: (r["error_code"], r["after_status"]) for r in L.judge_actions(whole).collect()}
    got = [r for r in judged.collect() if r["error_code"] != T.LATE]
    assert {r["seq"]: (r["error_code"], r["after_status"]) for r in got} == want and len(got) == len(log)
    assert [(r["seq"], r["error_code"]) for r in T.refused(judged).where("seq = 1").collect()] == [(1, T.LATE)]
    assert T.accepted(judged).count() + T.refused(judged).count() == judged.count()


def test_listing_filters_and_total(spark):
    rows = [(f"c{i:02d}", "OPEN" if i % 3 else "SHUT", f"m{i % 2}", float(i % 5)) for i in range(30)]
    cases = spark.createDataFrame(rows, "case_id string, status string, municipality_id string, score double")
    page, total = L.list_cases(cases, offset=1, limit=4, status=["OPEN"], municipality_id="m1", ward_id=None)
    fit = sorted((r for r in rows if r[1] == "OPEN" and r[2] == "m1"), key=lambda r: (-r[3], r[0]))
    assert [r["case_id"] for r in page.collect()] == [r[0] for r in fit[1:5]]
    assert total.first()["total"] == len(fit)
    assert L.list_cases(cases, status=[])[1].first()["total"] == 0


def test_parent_flags_combine_by_hash_and_the_last_row_counts(spark):
    r = "struct<reason:string,stage:string>"
    rows = spark.createDataFrame([("p", 1, None), ("p", 3, ("X", "y")), ("p", 2, None), ("q", None, None), (None, 1, None)], f"id string, ordinal long, _r {r}")
    flags = V._parent(rows, "id", "p")
    assert {x["_p_key"]: x["_p"]["ok"] for x in flags.collect()} == {"p": False, "q": True, None: True}
    for df in (flags, V._parent(rows.drop("ordinal"), "id", "p")):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_case_ids_are_looked_up_once_each(spark, monkeypatch):
    stored = []
    real = V.cut_lineage
    monkeypatch.setattr(V, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
    r = "struct<reason:string,stage:string>"
    done = {name: spark.createDataFrame([("ok", None), ("bad", ("X", "y"))], f"{key} string, _r {r}") for name, key in (
        ("parcels", "parcel_id"), ("approved_buildings", "building_id"), ("permits", "permit_id"), ("inspectors", "inspector_id"),
        ("imagery_assets", "asset_id"), ("complaints", "complaint_id"))}
    kinds = [("a", ["ok"], []), ("b", ["ok", "bad"], []), ("c", ["ok"], ["gone"]), ("d", ["ok", None], []), ("e", None, ["ok"]),
             ("f", ["ok"], []), ("f", ["bad"], []), (None, ["bad"], [])] + [(f"x{i}", ["gone", "bad"], ["bad"]) for i in range(40)]
    cases = spark.createDataFrame(
        [(c, "ok", "ok", "ok", "ok", a, k) for c, a, k in kinds] + [("g", "bad", "ok", "ok", "ok", ["ok"], []), ("h", "ok", "ok", None, "ok", ["ok"], [])],
        "case_id string, parcel_id string, building_id string, permit_id string, inspector_id string, imagery_asset_ids array<string>, "
        "complaint_ids array<string>").withColumn("observed_footprint", G.box(*[F.lit(float(v)) for v in (0, 0, 1, 1)]))
    out = V._cases(cases, done).collect()
    assert len(out) == cases.count()
    rejected = sorted({str(x["case_id"]) for x in out if x["_r"] is not None and x["_r"]["reason"] == "INVALID_CASE_RELATIONSHIP"})
    assert rejected == sorted(["b", "c", "d", "f", "g", "h", *[f"x{i}" for i in range(40)]])
    assert [df.count() for df in stored[:2]] == [3, 2]
