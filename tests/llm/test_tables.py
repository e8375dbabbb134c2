"""Vectors, URLs, the registered queries beside their SQL, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, kept_lines, mix_targets, n_words, rows, save
from oracle_check import compare, connect
from test_near_dedup import least_ids
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from landshift.llm import bpe, kd_search, queries, quality_model, url_filter

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql_twin(spark, name):
    ok, _took, note = compare(spark, connect(ROOT), ROOT, name, queries.QUERIES, queries.ORACLE)
    assert ok, note


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", x)[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names


# ---------------------------------------------------------------- top-k

def brute(given, asks, k):
    whole = {(i, tuple(int(np.floor(np.float64(x) * 256)) for x in v)) for i, v in given if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in whole:
        if asks(q):
            found = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v)})
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    given = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(400)]
    given += [(400 + i, given[5][1]) for i in range(60)]  # one vector many times: ties
    given += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), given[7], (504, [0.1, 0.2]), (505, [3e5] * 8), (510, [0.0] * 8), (506, []), (520, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in given], "vec_id bigint, embedding array<float>, id string, rank int")
    want = brute(given, lambda q: q % 10 == 0, 5)
    for shard_rows, query_rows, leaf in ((10_000, 10_000, 16), (60, 9, 4)):
        got = kd_search.top_k(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard_rows, query_rows=query_rows, leaf=leaf)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert kd_search.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    few = kd_search.top_k(df.where("vec_id < 3"), F.col("vec_id") % 10 == 0)
    assert [(r["query_id"], r["rank"]) for r in few.collect()] == [(0, 1), (0, 2)]


def test_trees_prune_with_tight_boxes():
    rng = np.random.default_rng(10)
    centres = rng.integers(-2000, 2000, (20, 6))
    vectors = np.repeat(centres, 100, axis=0) + rng.integers(-10, 10, (2000, 6))
    tree = kd_search.Tree(np.arange(2000), vectors, 32)
    for node, (a, b) in enumerate(tree.span):
        if b > a:
            assert (tree.vectors[a:b].min(axis=0) == tree.low[node]).all() and (tree.vectors[a:b].max(axis=0) == tree.high[node]).all()
    looked = []
    rows_of, plain = tree.vectors.astype(np.float64), heapless(tree, looked)
    ids, scores = tree._best_first(-1, vectors[0].astype(np.float64), plain(rows_of), np.maximum(vectors[0], 0) @ tree.high.T + np.minimum(vectors[0], 0) @ tree.low.T, 5, kd_search.NONE)
    assert sum(looked) < 1000
    every = vectors @ vectors[0]
    assert sorted(scores.tolist()) == sorted(every[np.lexsort((np.arange(2000), -every))[:5]].tolist())


def heapless(tree, looked):
    class Seen:
        def __init__(self, rows_of):
            self.rows_of = rows_of

        def __getitem__(self, part):
            looked.append(part.stop - part.start)
            return self.rows_of[part]
    return Seen


# ---------------------------------------------------------------- URLs

def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow")))


def test_urls_with_many_entries(spark):
    rnd = random.Random(11)
    label = lambda: rnd.choice(["a", "b", "net", "org", "Ex", "é"])
    rules = [(".".join(label().lower() for _ in range(rnd.randint(1, 3))), rnd.choice(["/", "/x", "/x/y", ""]), rnd.choice(["allow", "block"])) for _ in range(80)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values()) + [(f"only{i}.example", "/", "block") for i in range(3000)]
    urls = [f"{rnd.choice(['http', 'https', ''])}{rnd.choice(['://', '://', ':', '/'])}{'.'.join(label() for _ in range(rnd.randint(1, 4)))}{rnd.choice(['', '/', '/x', '/x/y/z', '/X', '?q=/x', '#f', '/x?u://n.net/'])}" for _ in range(400)]
    urls += [None, "", "://", "http://", "http:///x", "HTTP://A.NET/x", "http://a.net\n/x", "http://only7.example/", "x" * 20_000 + "://a/", urls[0], urls[0]]
    pages = spark.createDataFrame([(None if i == 4 else i, u, "h", "k") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    entries = spark.createDataFrame(rules, "host string, path string, verdict string")
    for blocks in (1 << 14, 4):  # a filter that passes nearly all still gives right results
        got = url_filter.judge(pages, entries, blocks=blocks).collect()
        want = [(None if i == 4 else i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
        assert collections.Counter(map(repr, want)) == collections.Counter(repr(tuple(r)) for r in got)
    none = url_filter.judge(pages, entries.where("false")).collect()
    assert len(none) == len(urls) and {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert url_filter.judge(pages.where("false"), entries).count() == 0


def test_bloom_filter_passes_listed_and_few_others(spark):
    keys = [f"host{i}.example/" for i in range(5000)]
    table = url_filter.bloom(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert url_filter.may_hold(table, keys).all()
    assert url_filter.may_hold(table, [f"other{i}.example/" for i in range(5000)]).mean() < 0.01


# ---------------------------------------------------------------- pipeline

def plain_pipeline(spark, given, folder):
    """The stages one after another; the classifier's own decisions are taken as they are, and tested elsewhere."""
    docs, labels = documents(spark, given), spark.read.parquet(f"{folder}/labels.parquet")
    sample, _ = quality_model.fit(docs, labels)
    stay = [tuple(r) for r in quality_model.filter_rows(docs, sample).collect()]
    cut = [(r[0], k[2], *r[2:4]) for r, k in zip(stay, kept_lines([r[:2] for r in stay]))]
    return cut, [r[0] == b for r, b in zip(cut, least_ids(cut))]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] + [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "word " * 30_000, "en", "src1", 150_000)]
    save(documents(spark, given), tmp_path)
    save(spark.read.parquet(f"{ROOT}/labels.parquet"), tmp_path, "labels")
    cut, stays = plain_pipeline(spark, given, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/stage{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    one = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in seen["simhash_dedup"].collect()]
    assert {r["doc_id"] for r in seen["line_dedup"].collect()} == {r[0] for r in cut}
    # what no near pair of sets joins stays, and of the others at most a tenth stays wrongly
    assert collections.Counter(r for r, s in zip(cut, stays) if s) <= collections.Counter(one) <= collections.Counter(cut)
    assert len(one) - sum(stays) <= 0.1 * (len(cut) - sum(stays))
    sizes = collections.Counter()
    for r in one:
        sizes[r[3]] += n_words(r[1])
    targets = mix_targets(sizes)
    taken = collections.Counter()
    texts = {r[0]: r[1] for r in one}
    for r in seen["source_mix"].collect():
        assert texts[r["doc_id"]].startswith(r["text"].rstrip("\n")) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += n_words(r["text"])
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes if sizes[s])
    mixed = collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in seen["source_mix"].collect())
    assert mixed == collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in docs.collect())
    back = bpe.decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert collections.Counter(r["text"] for r in back) == collections.Counter(r["text"] for r in seen["source_mix"].collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(repr, whole.collect())) == collections.Counter(map(repr, docs.collect()))


def test_pipeline_on_awkward_rows(spark, tmp_path):
    for i, given in enumerate((rows(), [])):
        folder = tmp_path / str(i)
        save(documents(spark, given, extra=True), folder)
        save(spark.createDataFrame([(j, int(j % 3 > 0), 0) for j in range(50 if given else 0)], "doc_id bigint, quality int, toxic int"), folder, "labels")
        assert corpus_pipeline.run(spark, str(folder)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
