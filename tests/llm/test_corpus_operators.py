"""Text operators against plain versions, on awkward rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import EXTRA, documents, fingerprint, components, kept_lines, mix_targets, n_words, rows, save, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landshift.llm import bpe, language, line_dedup, mixing, quality_model, quality_rules, simhash, token_files
from landshift.llm.arrow import text_bytes
from landshift.llm.pieces import cut, distinct

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def by_row(given, got):
    """Multisets of results: rows of one id and text are alike."""
    assert collections.Counter(map(repr, given)) == collections.Counter(map(repr, got))


# ---------------------------------------------------------------- pieces and merges

def test_pieces_equal_the_pattern():
    import pyarrow as pa
    rnd = random.Random(1)
    parts = ["a", "'", "s", "re", "ve", "ll", "t", " ", "  ", "\n", "\t", "é", "1", "²", "!", "漢", "🙂", "'s", "'re", "\u0301", "\r\n", "\x1c", "\x85", "\u3000"]
    given = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    starts, lengths, counts = cut(*text_bytes(pa.array(given, pa.string())))
    raw, at, pattern = "".join(given).encode(), 0, regex.compile(public_tokenizers.PATTERN)
    for t, end in zip(given, counts.tolist()):
        assert [raw[a:a + n].decode() for a, n in zip(starts[at:end], lengths[at:end])] == pattern.findall(t)
        at = end


def test_distinct_does_not_trust_hashes(monkeypatch):
    from landshift.llm import pieces
    data = np.frombuffer(b"abcabdabc", np.uint8)
    starts, lengths = np.array([0, 3, 6]), np.array([3, 3, 3])
    monkeypatch.setattr(pieces, "hashes", lambda *a: np.zeros(3, np.uint64))
    first, inverse = distinct(data, starts, lengths)
    assert first.tolist() == [0, 1] and inverse.tolist() == [0, 1, 0]


def _tiktoken(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("extra", [False, True])
def test_bpe_equals_the_library_and_round_trips(spark, extra):
    enc = _tiktoken(MULTI)
    want = []
    for i, t, *_ in rows():
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    by_row(want, [tuple(r) for r in bpe.digests(documents(spark, extra=extra), MULTI).collect()])


def test_bpe_ids_decode_to_the_texts(spark):
    docs = documents(spark)
    back = bpe.decode(bpe.encode(docs, MULTI), MULTI).collect()
    by_row([(r[0], r[1] or "") for r in rows()], [(r["doc_id"], r["text"]) for r in back])


def test_bpe_long_pieces_take_the_heap():
    v, enc = bpe.vocabulary(MULTI), _tiktoken(MULTI)
    rnd = random.Random(2)
    for t in ["".join(rnd.choice("abcdeén") for _ in range(n)) for n in (255, 256, 257, 600, 3000)] + ["a" * 20_000]:
        ids, counts = v.encode([t.encode()])
        assert ids.tolist() == enc.encode_ordinary(t) and counts.tolist() == [len(ids)]


# ---------------------------------------------------------------- token files

def test_token_files_hold_what_the_library_gives(spark, tmp_path):
    t = Tokenizer.from_file(BYTES)
    given = sorted({r for r in rows() if r[0] is not None}, key=lambda r: r[0])
    manifest = token_files.write(documents(spark, given, extra=True), BYTES, 2, str(tmp_path))
    start, want = 0, []
    for i, x, *_ in given:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.read(manifest).collect()) == want


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    got = token_files.read(token_files.write(documents(spark), BYTES, 2, str(tmp_path))).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows())
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_reader_decompresses_only_what_is_asked(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    docs = {i: rng.integers(0, 50_000, rng.integers(0, 9000)).astype(np.uint32) for i in range(300)}
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as out:
        w = token_files.Writer(out)
        for a in range(0, 300, 50):
            part = [docs[i] for i in range(a, a + 50)]
            w.add(np.arange(a, a + 50), np.array([len(x) for x in part]), np.concatenate(part))
        w.close()
    seen, plain = [], token_files.Reader.frame
    monkeypatch.setattr(token_files.Reader, "frame", lambda self, i: seen.append(i) or plain(self, i))
    got = token_files.read_documents(path, [3, 150, 299, 999])
    assert set(got) == {3, 150, 299} and all(np.array_equal(got[i], docs[i]) for i in got)
    with open(path, "rb") as stream:
        assert len(set(seen)) <= 3 < len(token_files.Reader(stream).table) - 1
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_files.read_documents(path, [0])


# ---------------------------------------------------------------- line dedup

@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_equals_the_rule(spark, extra):
    given = rows()
    want = [(r[0], *k) for r, k in zip(given, kept_lines([r[:2] for r in given]))]
    out = line_dedup.dedup(documents(spark, extra=extra), name="stats")
    got = [(r["doc_id"], r["stats"]["n_lines"], r["stats"]["n_dropped"], r["text"]) for r in out.collect()]
    by_row(want, got)
    assert sum(w[2] for w in want) > 20
    assert all(r["stats"]["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out.collect())


def test_line_index_is_reversible(spark):
    given = [r for r in rows(n=50) if r[0] is not None]
    first, later = [r for r in given if r[0] % 3], [r for r in given if r[0] % 3 == 0]
    whole = line_dedup.LineIndex.build(documents(spark, given))
    start = line_dedup.LineIndex.build(documents(spark, first))
    grown = start.insert(documents(spark, later))
    back = grown.delete(documents(spark, later).select("doc_id").distinct())

    def state(index):
        return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.posted.collect()))

    assert state(grown) == state(whole) and state(back) == state(start) != state(grown)
    for index, docs in ((grown, given), (back, first)):
        want = [(r[0], k[1], k[2]) for r, k in zip(docs, kept_lines([r[:2] for r in docs]))]
        got = [(r["doc_id"], r["_lines"]["n_dropped"], r["text"]) for r in index.apply(documents(spark, docs)).collect()]
        by_row(want, got)


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(4)
    hi, lo = (rng.integers(-2**63, 2**63 - 1, 900) for _ in range(2))
    c = line_dedup.Cuckoo.empty(256)
    c.insert(hi, lo)
    assert c.table is not None and c.may_hold(hi, lo).all()
    other = rng.integers(-2**63, 2**63 - 1, (2, 20_000))
    assert c.may_hold(*other).mean() < 0.01
    c.delete(hi[:450], lo[:450])
    assert c.may_hold(hi[450:], lo[450:]).all() and c.may_hold(hi[:450], lo[:450]).mean() < 0.05
    c.delete(hi[450:], lo[450:])
    assert not c.table.any()
    full = line_dedup.Cuckoo.empty(4)
    full.insert(hi, lo)
    assert full.table is None and full.may_hold(*other).all()


# ---------------------------------------------------------------- SimHash

def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 23, 4000)
    found = simhash.codewords(x)
    assert set((found >= 0).sum(axis=1).tolist()) == {1, 6}
    for n in (1, 2):
        y = x.copy()
        for _ in range(n):
            y ^= 1 << rng.integers(0, 23, len(x))
        other = simhash.codewords(y)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(found, other))
        if n == 1:
            assert all(a[0] in b for a, b in zip(found, other))


@pytest.mark.parametrize("extra", [False, True])
def test_simhash_groups_equal_brute_force(spark, extra):
    given = rows()
    prints = [fingerprint(r[1]) for r in given]
    want = [(r[0], format(p, "016x"), c) for r, p, c in zip(given, prints, components([r[0] for r in given], prints))]
    by_row(want, [tuple(r) for r in simhash.groups(documents(spark, extra=extra)).collect()])


def test_print_links_join_crowds(spark):
    rnd = random.Random(6)
    prints = set()
    for centre, n in ((rnd.getrandbits(64), 1500), (rnd.getrandbits(64), 40), (0, 30)):
        for _ in range(n):
            y = centre
            for _ in range(rnd.randrange(6)):
                y ^= 1 << rnd.randrange(64)
            prints.add(y)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    links = [tuple(int(np.int64(v).view(np.uint64)) for v in r) for r in simhash.print_links(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(p) for p in prints] == components(prints, prints)
    with pytest.raises(ValueError):
        simhash.print_links(df, 4)


def test_keep_one_leaves_the_least_document(spark):
    given = rows()
    prints = [fingerprint(r[1]) for r in given]
    best = components([r[0] for r in given], prints)
    want = [r for r, b in zip(given, best) if r[0] == b]
    got = simhash.keep_one(documents(spark, extra=True))
    assert got.columns[-1] == "NAME"
    by_row(want, [tuple(r[:5]) for r in got.collect()])


# ---------------------------------------------------------------- language

def test_language_on_clear_and_mixed_texts(spark):
    rnd = random.Random(7)
    vocab = {"aa": ["tok", "kota", "takko", "otak"], "bb": ["sim", "misi", "imsi", "mimis"], "cc": ["ré", "réru", "urré", "éru"]}
    make = lambda lang, n: " ".join(rnd.choice(vocab[lang]) for _ in range(n))
    train = [(i, make(lang, 80), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    train += [(100, None, "aa", "s", 1), (101, "", None, "s", 1), (102, make("aa", 5), None, "s", 1)]
    model = language.learn(documents(spark, train))
    assert model.languages == ["aa", "bb", "cc"]
    asked = [(0, make("aa", 30), None, None, 0), (1, make("bb", 60) + "\n" + make("cc", 40), None, None, 0), (2, "12 34 !!", None, None, 0),
             (3, None, None, None, 0), (4, "", None, None, 0), (5, "ré", None, None, 0), (6, make("bb", 50_000), None, None, 0), (0, "kota", "zz", None, 0)]
    got = language.predict(documents(spark, asked, extra=True), model, keep=("lang",)).collect()
    pred = [r["lang_pred"] for r in got]
    assert pred == ["aa", "bb", "und", "und", "und", "cc", "bb", "aa"]
    assert [r["score"] > 0 for r in got] == [p != "und" for p in pred] and all(0 <= r["score"] <= 1 for r in got)
    assert set(got[0]["languages"]) == {"aa"} and set(got[1]["languages"]) == {"bb", "cc"}
    assert abs(got[1]["languages"]["bb"] - 0.6) < 0.1
    empty = language.learn(documents(spark, []))
    assert empty.languages == [] and {r["lang_pred"] for r in language.predict(documents(spark, asked), empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = [r for r in language.op5_language_id(spark, root).collect() if r["held_out"]]
    assert len(got) > 100 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.98


# ---------------------------------------------------------------- quality rules

def _base(text):
    import re
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@pytest.mark.parametrize("extra", [False, True])
def test_base_rules_and_verdicts(spark, extra):
    rnd = random.Random(8)
    given = rows() + [(1000 + i, "".join(rnd.choice(["a", "b ", " ", "\n", "é", "#", "\n\n", " \n", "a b a b "]) for _ in range(rnd.randint(0, 50))), "en", "s", 0) for i in range(150)]
    measured = quality_rules.measure(
        documents(spark, given, extra=extra), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), keep=("lang",))
    got = quality_rules.judge(measured, "lang").collect()
    want = [(r[0], *_base(r[1])) for r in given]
    by_row(want, [(r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in got])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] is not None


def test_fertility_equals_the_libraries(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    enc = _tiktoken(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    given = [(i, t, "en", "s", 0) for i, t in enumerate(["one two three", "漢字 🙂 x", "tok " * 50, "Zürich"])]
    got = quality_rules.measure(documents(spark, given), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    for r, (_, t, *_rest) in zip(got, given):
        ids = [x for w in t.split() for x in enc.encode_ordinary(" " + w)]
        pieces = [x for w in t.split() for x in sp.encode(w)]
        assert r["chars_per_token"] == pytest.approx(sum(map(len, t.split())) / len(ids))
        assert r["byte_share"] == pytest.approx(np.mean([sp.is_byte(x) for x in pieces]))
        p = np.array(list(collections.Counter(ids).values())) / len(ids)
        assert r["token_entropy"] == pytest.approx(float(-(p * np.log2(p)).sum() / np.log2(len(ids))))


def test_rules_keep_clean_documents(spark):
    root = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in spark.read.parquet(f"{root}/labels.parquet").where("quality = 1").collect()}
    got = [r for r in quality_rules.op7_quality_rules(spark, root).collect() if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([r["kept"] for r in got]) > 0.99


# ---------------------------------------------------------------- quality classifier

def test_classifier_keeps_clean_and_drops_junk(spark):
    root = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    got = quality_model.op9_quality_classifier(spark, root).collect()
    assert len(got) == 1000
    kept = lambda q: np.mean([r["kept"] for r in got if quality.get(r["doc_id"]) == q])
    assert kept(1) > 0.99 and kept(0) < 0.15


def test_classifier_on_awkward_rows(spark):
    docs = documents(spark, extra=True)
    label = lambda given: spark.createDataFrame(given, "doc_id bigint, quality int")
    for given in ([], [(1, 1), (2, 1)], [(1, 0)], [(None, 1), (1, None)], [(i, int(i % 4 > 0)) for i in range(60)] + [(1, 1)]):
        sample, weighed = quality_model.fit(docs, label(given))
        out = quality_model.filter_rows(docs, sample)
        assert out.columns == docs.columns and weighed.count() == docs.count()
        mine = weighed.where(sample.keep(F.col("_weight"), "id")).select("id").collect()
        assert collections.Counter(r["id"] for r in mine) == collections.Counter(r["doc_id"] for r in out.collect())
        if len({q for _, q in given if q is not None}) < 2:
            assert out.count() == docs.count()
    sample, weighed = quality_model.fit(documents(spark, []), label([]))
    assert weighed.count() == 0 and quality_model.filter_rows(documents(spark, []), sample).count() == 0


def test_weights_equal_a_plain_sum(spark):
    import pyarrow as pa
    given = [r for r in texts() if r is not None and len(r) < 2000]
    data, ends = text_bytes(pa.array(given, pa.string()))
    bucket, of = quality_model.features(data, ends)
    for i in range(0, len(given), 5):
        alone, _ = quality_model.features(*text_bytes(pa.array([given[i]], pa.string())))
        assert sorted(alone.tolist()) == sorted(bucket[of == i].tolist())
        n = len(given[i].encode())
        assert (alone < quality_model.TEXT_BUCKETS).sum() == max(0, n - 2)


def test_gumbel_top_k_takes_k(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words go here number "), (F.col("id") % 3).cast("string")).alias("text"))
    sample, weighed = quality_model.fit(docs, spark.createDataFrame([(i, int(i % 2)) for i in range(200)], "doc_id bigint, quality int"))
    above = weighed.where(F.col("_weight") > sample.model.cut).count()
    assert quality_model.filter_rows(docs, sample).count() == above


# ---------------------------------------------------------------- mixing

@pytest.mark.parametrize("extra", [False, True])
def test_mix_meets_the_targets(spark, extra):
    given = rows()
    sizes = collections.Counter()
    for _, t, _, s, _ in given:
        sizes[s] += n_words(t)
    want = mix_targets(sizes)
    mixed = mixing.mix(documents(spark, extra=extra), name="m")
    got = mixed.collect()
    assert len(got) == len(given)
    taken = collections.Counter()
    for r in got:
        m = r["m"]
        assert m["size"] == n_words(r["text"]) and m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(want[r["source"]]) and 0 <= m["taken"] <= 2 * m["size"]
        taken[r["source"]] += m["taken"]
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, extra=extra), name="m").collect()))
    out = mixing.repeated(mixed, name="m")
    assert out.columns == documents(spark, extra=extra).columns
    words = collections.Counter()
    for r in out.collect():
        words[r["source"]] += n_words(r["text"])
    assert words == +taken


def test_mix_of_nothing_and_of_wordless_rows(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r["_mix"]["size"], r["_mix"]["target"], r["_mix"]["taken"]) for r in got] == [(0, 0.0, 0)] * 2


# ---------------------------------------------------------------- all of them

def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    save(none, tmp_path)
    assert bpe.digests(none, MULTI).count() == 0
    assert token_files.read(token_files.write(none, BYTES, 2, str(tmp_path / "t"))).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert simhash.groups(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert quality_rules.op7_quality_rules(spark, str(tmp_path)).count() == 0
    index = line_dedup.LineIndex.build(none)
    assert index.insert(none).delete(none.select("doc_id")).counts.count() == 0


def test_clashing_names_are_many():
    assert len(EXTRA.split(", ")) == 9
