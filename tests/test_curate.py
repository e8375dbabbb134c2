"""Content hashes of rasters and pairs, the hash rule of samples, coverage of the report."""

import hashlib

from landshift.operators import curate as U


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _pixels(spark):
    rows = [(p, r, c, 10 * p + r, 7 - c, r + c, int(p == 1 and r == c)) for p in (1, 2) for r in range(3) for c in range(2)]
    return rows, spark.createDataFrame(rows, "pair_id bigint, row int, col int, old_b1 int, old_b2 int, new_b1 int, target int").selectExpr(
        "*", "old_b1 + 1 as new_b2", "0 as old_mask", "0 as new_mask").repartition(5)


def _expected(rows, pair):
    def image(cell):
        lines = [_sha(";".join(cell(x) for x in rows if x[:2] == (pair, r))) for r in range(3)]
        return _sha("3|2|" + "".join(lines))
    return _sha(image(lambda x: f"{x[3]},{x[4]}") + "|" + image(lambda x: f"{x[5]},{x[3] + 1}"))


def test_pair_hash_rule_and_coverage(spark):
    rows, px = _pixels(spark)
    got = {r["pair_id"]: r["pair_sha256"] for r in U.pair_hash(px, ["b1", "b2"]).collect()}
    assert got == {p: _expected(rows, p) for p in (1, 2)}
    meta = spark.createDataFrame(
        [(1, 2, 3, "accepted", True, 0.9, got[1], "train"), (2, 2, 3, "rejected", True, 0.9, got[1], "test"), (3, 2, 3, "accepted", True, 0.9, None, "test")],
        "pair_id bigint, width int, height int, label_quality string, transform_plausible boolean, overlap_ratio double, pair_sha256 string, split string")
    found = {r["pair_id"]: r["violations"] for r in U.sample_violations(px, meta, bands=["b1", "b2"]).collect()}
    assert found[1] == [] and found[2] == ["PAIR_HASH_MISMATCH", "LABEL_REJECTED"]
    assert found[3][0] == "DIMENSIONS"
    report = {(r["kind"], r["name"]): (r["n"], r["ratio"]) for r in U.dataset_report(px, meta).collect()}
    assert report["coverage", "labelled"] == (2, 2 / 12) and report["empty", "samples"] == (1, None)
    assert report["split", "test"] == (2, None) and report["class", "0"] == (10, None)
    none = {(r["kind"], r["name"]): (r["n"], r["ratio"]) for r in U.dataset_report(px.where("false"), meta.where("false")).collect()}
    assert none["coverage", "labelled"] == (0, None)
