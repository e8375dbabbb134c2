"""Added tokens, clashing default names, and the draw of the quality classifier."""

import collections
import math

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import documents, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landshift.llm import language, line_dedup, mixing, quality_model, token_files
from landshift.llm.arrow import text_bytes

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_cut_first_as_the_library_does():
    end = "<|endoftext|>"
    given = [f"x {end} y", end, f"{end}{end}", f" {end} ", "<|endoftext", "|>", f"é{end}漢 a", "", "plain words", f"<|{end}|>", "<|endof", "text|>", f"it's {end}'s"]
    library = Tokenizer.from_file(BYTES)
    ids, upto = token_files.token_ids(token_files._pieces(BYTES), BYTES, *text_bytes(pa.array(given, pa.string())))
    at = np.append(0, upto)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in given]
    assert len(library.encode(given[0], add_special_tokens=False).ids) == 4


def test_added_tokens_in_files(spark, tmp_path):
    given = [(i, t, None, None, None) for i, t in enumerate(["a <|endoftext|> b", None, "<|endoftext|>", "c"])]
    got = token_files.read(token_files.write(documents(spark, given), BYTES, 2, str(tmp_path))).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {0: 5, 1: 1, 2: 2, 3: 2}


def test_default_names_leave_given_columns(spark):
    docs = documents(spark, extra=True)
    mixed, lines = mixing.mix(docs), line_dedup.dedup(docs)
    assert mixed.columns == [*docs.columns, "_mix_"] and {r[0] for r in mixed.select("_mix").collect()} == {2}
    assert lines.columns == [*docs.columns, "_lines_"] and {r[0] for r in lines.select("_lines").collect()} == {"l"}
    scored = docs.withColumn("score", F.lit("mine"))
    got = language.predict(scored, language.learn(docs), keep=("score",))
    assert got.columns == ["doc_id", "score", "lang_pred", "score_", "languages"] and {r["score"] for r in got.collect()} == {"mine"}


def test_draw_equals_a_plain_gumbel_top_k(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    kept = {}
    for seed in (1, 2, 3, 4):
        sample, weighed = quality_model.fit(docs, labels, seed=seed)
        hashed = weighed.select("id", "_weight", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)).alias("u")).collect()
        scale = 1024 * sample.model.temperature
        keys = {r["id"]: r["_weight"] / scale - math.log(-math.log((r["u"] + 0.5) / (1 << 52))) for r in hashed}
        k = sum(r["_weight"] > sample.model.cut for r in hashed)
        want = set(sorted(keys, key=keys.get, reverse=True)[:k])
        kept[seed] = {r["id"] for r in weighed.where(sample.keep(F.col("_weight"), "id")).collect()}
        assert kept[seed] == want
    # chance decides near the cut: weights within a few temperatures of it, here as many made-up rows
    near = spark.range(4000).select("id", (F.lit(sample.model.cut) + (F.col("id") % 200 - 100) * scale / 25).alias("w"))
    drawn = [{r["id"] for r in near.orderBy(quality_model.gumbel_key(F.col("w"), "id", sample.model.temperature, s).desc()).limit(2000).collect()} for s in (1, 2)]
    assert 50 < len(drawn[0] - drawn[1]) < 1500
    assert collections.Counter(i % 200 > 150 for i in drawn[0])[True] > 970  # far above the cut nearly all are in
