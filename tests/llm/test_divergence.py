"""Source divergence against the SQL twin on awkward rows, and skybands against counted dominators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, rows, save
from oracle_check import compare, connect

from landshift.llm import divergence
from landshift.llm.queries import ORACLE, QUERIES

NAME = "op12_source_divergence"


def awkward():
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ["", "é", "x", "漢", "Z"]]
    made = [(100 + i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]),
             rnd.choice(["s1", "s2", "S3", None, "é"]), 1) for i in range(200)]
    lone = [(900, "lone words", "xx", "s1", 1), (901, None, "xx", "s2", None), (902, "only only only", "yy", "s1", 1), (903, "a a", "yy", "s1", 1), (904, "a", "yy", "s1", 1), (905, "a only", "yy", "s1", 1)]
    return [*made, *made[:30], *lone, *rows()]


@pytest.mark.parametrize("given", [awkward(), []], ids=["awkward", "empty"])
def test_audit_equals_its_twin(spark, tmp_path, given):
    save(documents(spark, given, extra=True), tmp_path)
    con = connect_documents(tmp_path)
    ok, _, note = compare(spark, con, str(tmp_path), NAME, QUERIES, ORACLE)
    assert ok, note


def connect_documents(folder):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def test_ranks_stop_at_the_limit(spark):
    given = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 7, 400, 1 + i % 5)), "en", f"s{i % 3}", 1) for i in range(60)]
    whole = divergence.audit(documents(spark, given), k=10_000).where("part = 'term'").collect()
    few = divergence.audit(documents(spark, given), k=15).where("part = 'term'").collect()
    assert sorted(map(tuple, few)) == sorted(tuple(r) for r in whole if r["rank"] <= 15) and len(whole) > len(few)


@pytest.mark.parametrize("k", [1, 4, 200])
def test_skyband_holds_what_fewer_than_k_dominate(monkeypatch, k):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    rng = np.random.default_rng(k)
    data = sorted({(-int(n), int(c), f"t{t:03d}") for n, c, t in zip(rng.integers(1, 12, 400), rng.integers(1, 12, 400), rng.integers(0, 300, 400))})
    want = [r for r in data if sum(o[0] <= r[0] and o[1] <= r[1] and o[2] < r[2] for o in data) < k]
    band, got = divergence.Band(k), []
    for a in range(0, len(data), 37):  # batches of any size
        part = data[a:a + 37]
        stay = band.add(np.array([-r[0] for r in part]), np.array([r[1] for r in part]), pa.array([r[2] for r in part]))
        got += [part[i] for i in stay]
    assert got == want


def test_merged_skybands_are_the_skyband(spark):
    rng = np.random.default_rng(3)
    data = [("en", "s", f"t{i:04d}", int(n), int(c)) for i, (n, c) in enumerate(zip(rng.integers(1, 30, 3000), rng.integers(1, 60, 3000)))]
    df = spark.createDataFrame(data, "lang string, source string, term string, n long, lang_n long")
    one = {r["term"] for r in divergence.skyband(df.coalesce(1), 20).collect()}
    parts = divergence.skyband(divergence.skyband(df.repartition(5), 20).coalesce(1), 20)
    assert {r["term"] for r in parts.collect()} == one and len(one) < 1500
