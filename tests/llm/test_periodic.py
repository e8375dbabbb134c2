"""Periodic runs against a plain version."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import WORD, documents, rows, save
from pyspark.sql import functions as F

from landshift.llm import periodic


def plain_runs(w):
    """(start, length, period) by start, then period: every lag's maximal stretches whose smallest period is the lag."""
    out = set()
    for d in range(1, len(w) // 4 + 1):
        i = d
        while i < len(w):
            if w[i] != w[i - d]:
                i += 1
                continue
            e = i
            while e < len(w) and w[e] == w[e - d]:
                e += 1
            s, n = i - d, e - i + d
            if n >= max(6, 4 * d) and not any(all(w[j] == w[j - q] for j in range(s + q, e)) for q in range(1, d)):
                out.add((s, n, d))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(doc_id, w):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    w = plant(doc_id, WORD.findall(text or ""))
    found = plain_runs(w)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def periodic_words(rnd):
    w = []
    while len(w) < rnd.randint(0, 120):
        kind = rnd.random()
        block = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
        if kind < 0.6:
            block = (block * 12)[:rnd.randint(1, len(block) * 8)]
        elif kind < 0.7:
            block = ((block[:3] * 4 + ["x"]) * 6)[:rnd.randint(1, 60)]  # runs within runs
        w += block
    return w


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_plain_runs(seed):
    rnd = random.Random(seed)
    given = [periodic_words(rnd) for _ in range(400)] + [[], ["a"] * 5, ["a"] * 6, ["a"] * 2000, ["a", "b"] * 500, list("abcabcabcabc"), list("xabcabcabcaby")]
    rnd.shuffle(given)
    ids = np.array([ord(c) for w in given for c in w], np.int64)
    upto = np.cumsum([len(w) for w in given])
    of, start, length, period = periodic.find_runs(ids, upto)
    got = collections.defaultdict(list)
    for t, s, n, q in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[t].append((s, n, q))
    for t, w in enumerate(given):
        assert got[t] == plain_runs(w), " ".join(w)


def test_cells_stay_few_for_one_word_many_times():
    n = 1 << 20
    of, start, length, period = periodic.find_runs(np.zeros(n, np.int64), np.array([n]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1])


def test_op11_equals_plain(spark, tmp_path):
    rnd = random.Random(7)
    given = [(i, " ".join(periodic_words(rnd)), None, None, None) for i in range(1000, 1250)] + [(*r[:1], r[1] and r[1][:9000], *r[2:]) for r in rows(seed=8, n=20)] + [(5000, "w " * 3000 + "x\ty" * 40, "en", "s", 1)]
    save(documents(spark, given), tmp_path)
    got = collections.Counter(map(repr, map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == collections.Counter(repr(plain(r[0], r[1])) for r in given)
    save(documents(spark, []), tmp_path)
    assert periodic.op11_periodic_runs(spark, str(tmp_path)).count() == 0


def test_collapse_keeps_columns_and_names(spark):
    given = documents(spark, [(1, "a b a b a b a b c", "en", "s", 3), (None, None, None, None, None), (2, " x ", "en", "s", 3)], extra=True)
    clash = given.withColumn("_periodic", F.lit("mine"))
    out = periodic.collapse(clash)
    assert out.columns == [*clash.columns, "_periodic_"]
    seen = {r["doc_id"]: (r["_periodic"], r["_periodic_"]["collapsed"], [tuple(x) for x in r["_periodic_"]["runs"]]) for r in out.collect()}
    assert seen == {1: ("mine", "a b c", [(0, 8, 2)]), None: ("mine", "", []), 2: ("mine", "x", [])}
