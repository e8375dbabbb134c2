import hashlib
import json
import uuid

from pyspark.sql import functions as F

from landshift.functions import boxes as G
from landshift.functions.metadata import has_sensitive_key, safe_metadata, uri_has_secrets
from landshift.functions.scalars import request_key, round2, uuid5_url
from landshift.operators.curate import split_of


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def B(a, b, c, d):
    return G.box(F.lit(a), F.lit(b), F.lit(c), F.lit(d))


def test_uuid5_matches_python(spark):
    got = one(spark, uuid5_url("asset", F.lit("m-1"), F.lit("ü")).alias("u"))["u"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "asset:m-1:ü"))


def test_request_key_matches_sorted_json(spark):
    key = request_key(F.array(F.lit("a"), F.lit("b")), F.lit("p"), F.lit("c"), F.lit("1"), F.lit("2"), F.lit("op"))
    text = json.dumps(
        {"source_asset_hashes": ["a", "b"], "image_pair_id": "p", "processing_configuration_hash": "c",
         "model_version": "1", "rule_set_version": "2", "operation_type": "op"}, sort_keys=True, separators=(",", ":"))
    assert one(spark, key.alias("k"))["k"] == hashlib.sha256(text.encode()).hexdigest()


def test_rounding_is_half_even_within_a_cent(spark):
    for x in (1.005, 0.125, 0.375, 17.5, 0.1 * 3):
        assert one(spark, round2(F.lit(x)).alias("r"))["r"] == round(x, 2)
    assert abs(one(spark, round2(F.lit(2.675)).alias("r"))["r"] - round(2.675, 2)) <= 0.0100001


def test_split_fraction_matches_python(spark):
    for name in ("tile-1", "pair-42"):
        value = int.from_bytes(hashlib.sha256(f"17:{name}".encode()).digest()[:8], "big") / 2**64
        want = "train" if value < 0.7 else "validation" if value < 0.85 else "test"
        assert one(spark, split_of(F.lit(name)).alias("s"))["s"] == want


def test_bbox_overlap_and_touch(spark):
    r = one(spark, G.strict_overlap(B(0, 0, 10, 10), B(5, 4, 12, 8)).alias("o"),
            G.strict_overlap(B(0, 0, 10, 10), B(10, 0, 20, 10)).alias("t"))
    assert tuple(r["o"]) == (5, 4, 10, 8) and r["t"] is None


def test_ring_area_and_faults(spark):
    def ring(*pts):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])

    square, bow = ring((0, 0), (4, 0), (4, 3), (0, 3), (0, 0)), ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))
    r = one(spark, G.ring_area(square).alias("a"), G.ring_faults(square).alias("ok"), G.ring_faults(bow).alias("bad"),
            G.ring_contains(square, F.lit(1.0), F.lit(1.0)).alias("i"), G.ring_contains(square, F.lit(5.0), F.lit(1.0)).alias("o"))
    assert r["a"] == 12 and not r["ok"] and r["bad"] and r["i"] and not r["o"]


def test_sensitive_metadata(spark):
    r = one(
        spark, has_sensitive_key(F.lit('{"a":{"Api-Key":1}}')).alias("k"),
        has_sensitive_key(F.lit('{"a":"x \\"password\\": y"}')).alias("v"),
        uri_has_secrets(F.lit("s3://u:p@h/x")).alias("u"), uri_has_secrets(F.lit("https://h/x?sig=1")).alias("q"),
        uri_has_secrets(F.lit("https://h/x")).alias("n"),
        safe_metadata(F.create_map(F.lit("userEmail"), F.lit("x"), F.lit("size"), F.lit("y" * 300))).alias("m"))
    assert r["k"] and not r["v"] and r["u"] and r["q"] and not r["n"]
    assert list(r["m"]) == ["size"] and len(r["m"]["size"]) == 256
