"""Plain versions of the operators' rules, and tables with awkward rows."""

import collections
import random
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with names that the operators use themselves.
EXTRA = "_weight int, _kept string, _lines string, _mix int, _id int, key string, print string, hi int, NAME string"


def texts(seed=5, n=60):
    rnd = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "Délta", "eps.", "zeta", "eta's", "漢字", "x1", "THE", "of"]
    lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(4, 9))) for _ in range(25)]
    out = ["\n".join(rnd.choice(lines) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(1, 6))) for _ in range(n)]
    out += [None, "", "\n", " \t ", "word", "two words", "\x00 nul", "é" * 30, "a" * 5000, "long " * 40_000, "🙂 emoji 🙂 emoji 🙂 emoji 🙂"]
    return out + out[:6]


def rows(seed=5, n=60):
    """Documents: null ids, null sources and languages, a repeated row, texts of many kinds."""
    out = []
    for i, t in enumerate(texts(seed, n)):
        out.append((None if i in (7, 20) else i, t, [None, "en", "fr", "de"][i % 4], [None, "s2", "s10", "é", "S1"][i % 5], None if t is None else len(t)))
    return [*out, out[3], out[3]]


def documents(spark, given=None, extra=False):
    given = rows() if given is None else given
    if not extra:
        return spark.createDataFrame(given, DOCS)
    return spark.createDataFrame([(*r, 1, "k", "l", 2, 3, "y", "p", 4, "N") for r in given], f"{DOCS}, {EXTRA}")


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def n_words(text):
    return len(WORD.findall(text or ""))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text, k=3):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    bits = [int(((h >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def components(ids, prints, radius=3):
    """{row number: least id of its component}."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist():
            root[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            members[find(i)].append(x)
    return [min(members[find(i)], default=None) for i in range(len(ids))]


def line_key(line):
    key = lower(line.strip(BLANK))
    return key if len(key) >= 20 else None


def kept_lines(given, min_docs=3):
    """[(n_lines, n_dropped, kept text)] of (id, text) rows; rows of one id are one document."""
    low = float("-inf")
    holders = collections.defaultdict(set)
    for i, t in given:
        for line in (t or "").split("\n"):
            if (k := line_key(line)) is not None:
                holders[k].add(low if i is None else i)
    out = []
    for i, t in given:
        lines = (t or "").split("\n")
        stay = [x for x in lines if (k := line_key(x)) is None or len(holders[k]) < min_docs or (low if i is None else i) == max(holders[k])]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} of {source: size} by clamping one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= over
    return target
