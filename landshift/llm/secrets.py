"""Secret scan (operator 13).

Three plain patterns find what announces itself. Other long strings are judged by character Markov models: of
ordinary strings (two characters back; prose, identifiers, numbers) and of random ones over the usual alphabets (one back).
A string's score is the log-likelihood ratio of its best random to its best ordinary model; above a cut it is a secret.

Labelled samples: ordinary are all strings of the corpus too short to be a secret, identifiers joined of a bounded sample of them, and
numbers; random are the values that the patterns find in the corpus, and seeded draws from each alphabet. The cut is set on labelled
strings that trained nothing. Likelihoods are whole numbers of 1/1024, so they don't depend on how rows are batched.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import distinct, hashes, words
from landshift.llm.quality_model import best_cut

# Patterns, least lengths and order of the kinds (fixed values).
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
VALUE, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")
SECRETS = "array<struct<kind:string,start:long,end:long,score:double>>"

#: Characters of a string that the models judge, its least length, and units of a ratio.
CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST, UNIT = 16, 1024
UPPER, LOWER, DIGITS = CHARS[:26], CHARS[26:52], CHARS[52:62]
#: A random string counts for the first alphabet that has all of its characters.
ALPHABETS = (DIGITS + b"abcdef", DIGITS + b"ABCDEF", DIGITS + LOWER, DIGITS + UPPER, DIGITS + LOWER + UPPER, CHARS)
#: Bound of the short strings that identifiers are joined of; labelled strings made per alphabet and as many identifiers in all.
MAX_WORDS, MADE, SEED = 20_000, 1000, 13
#: What an ordinary string called random costs, against 1 for the reverse; weight of the shorter context's share.
HARM, PRIOR = 50.0, 8.0

_CODE = np.zeros(256, np.int64)
_CODE[list(CHARS)] = np.arange(1, len(CHARS) + 1)
_SIZE = len(CHARS) + 1
_HEX = np.zeros(256, bool)
_HEX[list(ALPHABETS[0])] = True


def _contexts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of two characters before and the character, string) of every character; 0 stands before a string."""
    at = ragged(starts, lengths)
    own = ragged(np.zeros(len(starts), np.int64), lengths)
    code = _CODE[data[at]]
    one = np.where(own > 0, np.append(0, code)[:-1], 0)
    two = np.where(own > 1, np.append([0, 0], code)[:-2], 0)
    return (two * _SIZE + one) * _SIZE + code, np.repeat(np.arange(len(starts)), lengths)


def _kind_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Index of the first alphabet that has all characters of each string, -1: none."""
    out = np.full(len(starts), -1, np.int64)
    at, of = ragged(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
    for k in reversed(range(len(ALPHABETS))):
        odd = np.ones(256, bool)
        odd[list(ALPHABETS[k])] = False
        out[np.bincount(of, odd[data[at]], len(starts)) == 0] = k
    return out


@dataclass
class Found:
    """Matches of a slice: kind, row, byte positions in ``data``; ``value``: where the secret itself starts and ends."""

    data: np.ndarray
    ends: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray


def _lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line feed after each, which no match holds, and the rows + 1 offsets."""
    data, ends = text_bytes(col)
    n = np.diff(ends)
    out = np.full(len(data) + len(n), 0x0A, np.uint8)
    begin = ends[:-1] + np.arange(len(n))
    out[ragged(begin, n)] = data
    return out, ends + np.arange(len(ends))


def _assignments(data: np.ndarray, raw: bytes) -> Iterator[re.Match]:
    """Matches, looked for only in lines that have one of the signs that every match holds; a match stays in its line."""
    signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    feeds = np.flatnonzero(data == 0x0A)
    for i in np.unique(np.searchsorted(feeds, signs)).tolist():
        yield from ASSIGN.finditer(raw, int(feeds[i - 1]) + 1 if i else 0, int(feeds[i]) if i < len(feeds) else len(raw))


def base_matches(col: pa.Array) -> Found:
    data, ends = _lines(col)
    raw = data.tobytes()
    rows = [(0, *m.span(), *m.span(1)) for m in _assignments(data, raw) if m.end(1) - m.start(1) >= VALUE]
    rows += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    starts, lengths, _ = words(data, np.array([0, len(data)]), _HEX)
    rows += [(2, a, a + n, a, a + n) for a, n in zip(starts[lengths >= HEX_LEAST].tolist(), lengths[lengths >= HEX_LEAST].tolist())]
    found = np.array(rows, np.int64).reshape(-1, 5)
    found = found[np.lexsort((found[:, 0], found[:, 1]))]
    return Found(data, ends, found[:, 0], found[:, 1], found[:, 2], found[:, 3:])


def strings(found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all maximal strings of ``CHARS``, and whether a base match touches each."""
    starts, lengths, _ = words(found.data, np.array([0, len(found.data)]), _CODE > 0)
    cover = np.zeros(len(found.data) + 1, np.int64)
    np.add.at(cover, found.start, 1)
    np.add.at(cover, found.end, -1)
    upto = np.append(0, np.cumsum(np.cumsum(cover) > 0))
    return starts, lengths, upto[starts + lengths] > upto[starts]


def _draws(seed: int) -> list[list[bytes]]:
    rng = np.random.default_rng(seed)
    return [[bytes(rng.choice(np.frombuffer(a, np.uint8), int(n))) for n in rng.integers(LEAST, 4 * LEAST, MADE)] for a in ALPHABETS]


def _identifiers(parts: list[bytes], seed: int) -> tuple[list[bytes], list[bytes]]:
    """(names, numbers) of the least length: short strings of the corpus joined bare, by signs, or in camel case; drawn digits
    joined alike, as digits alone are labelled ordinary whatever they look like."""
    rng = np.random.default_rng(seed)
    plain = [w for w in parts if not w.isdigit()] or [b"name"]
    digits = [b"%d" % rng.integers(10 ** int(rng.integers(1, 9))) for _ in range(MADE)]
    signs = (b"", b"_", b"-", b"/", b"")

    def joined(word: list[bytes], style: int) -> bytes:
        made = b""
        while len(made) < LEAST:
            w = word[int(rng.integers(len(word)))]
            made += (signs[style] if made else b"") + (w.capitalize() if style == 4 and made else w)
        return made

    names = [joined(plain, i % 5) + (digits[int(rng.integers(len(digits)))] if i % 4 == 0 else b"") for i in range(5 * MADE)]
    return names, [joined(digits, i % 4) for i in range(5 * MADE)]


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


def _back_off(n: np.ndarray) -> np.ndarray:
    """Log shares of a character after those before it, drawn towards the shares of ever shorter contexts."""
    out = np.full(_SIZE, 1 / (_SIZE - 1))
    for keep in range(1, n.ndim + 1):
        counts = n.sum(axis=tuple(range(n.ndim - keep)))
        out = (counts + PRIOR * out) / (counts.sum(axis=-1, keepdims=True) + PRIOR)
    return np.log(out)


@dataclass
class Model:
    """Log shares in 1/1024: of random strings by alphabet and pair, of ordinary ones by kind and context; and the cut."""

    chance: np.ndarray
    usual: np.ndarray
    cut: float

    def score(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at, of = _contexts(data, starts, lengths)
        best = [np.max([np.bincount(of, m[x], len(starts)) for m in models], axis=0)
                for models, x in ((self.chance, at % (_SIZE * _SIZE)), (self.usual, at))]
        return (best[0] - best[1]).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", limit: int = MAX_WORDS) -> Model:
    """Models from all texts; driver and tasks hold tables of fixed size and at most ``limit`` short strings, the least by hash.

    Null and empty texts add nothing; an empty table leaves the made samples.
    """
    room = _SIZE ** 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, chance = np.zeros(room, np.int64), np.zeros((len(ALPHABETS), _SIZE * _SIZE), np.int64)
        least: dict[int, bytes] = {}
        for part in slices(batches, text):
            found = base_matches(part.column(text))
            starts, lengths, taken = strings(found)
            short = ~taken & (lengths < LEAST)
            first, same = distinct(found.data, starts[short], lengths[short])
            starts, lengths = starts[short][first], lengths[short][first]
            at, of = _contexts(found.data, starts, lengths)
            plain += np.bincount(at, np.bincount(same)[of], room).astype(np.int64)
            h = (hashes(found.data, starts, lengths) >> np.uint64(1)).astype(np.int64)
            low = np.argsort(h)[:limit]
            for i in low[h[low] < max(least, default=1 << 62) if len(least) >= limit else low >= 0].tolist():
                least[int(h[i])] = found.data[starts[i]:starts[i] + lengths[i]].tobytes()
            if len(least) > 2 * limit:
                least = {k: least[k] for k in heapq.nsmallest(limit, least)}
            a, n = found.value[:, 0], found.value[:, 1] - found.value[:, 0]
            kind = _kind_of(found.data, a, n)
            at, of = _contexts(found.data, a[kind >= 0], n[kind >= 0])
            np.add.at(chance, (kind[kind >= 0][of], at % (_SIZE * _SIZE)), 1)
        some = np.flatnonzero(plain)
        yield _rows(np.zeros(len(some), np.int64), some, plain[some])
        where, pair = np.nonzero(chance)
        yield _rows(where + 1, pair, chance[where, pair])
        keys = heapq.nsmallest(limit, least)
        yield _rows(np.full(len(keys), -1), np.array(keys, np.int64), np.ones(len(keys), np.int64), [least[k] for k in keys])

    seen = map_batches(docs.select(text), run, "part int, key long, n long, word binary")
    tables = seen.where("part >= 0").groupBy("part", "key").agg(F.sum("n").alias("n"))
    parts = seen.where("part = -1").groupBy("key").agg(F.min("word").alias("word")).orderBy("key").limit(limit)
    got = tables.withColumn("word", F.lit(None).cast("binary")).unionByName(
        parts.select(F.lit(-1).alias("part"), "key", F.lit(1).cast("long").alias("n"), "word")).toArrow()
    part, key, n = (got.column(c).to_numpy() for c in ("part", "key", "n"))
    plain, chance = np.zeros(room), np.zeros((len(ALPHABETS), _SIZE * _SIZE))
    plain[key[part == 0]] = n[part == 0]
    chance[part[part > 0] - 1, key[part > 0]] = n[part > 0]
    order = np.argsort(key[part < 0], kind="stable")
    known = [w for w, p in zip(got.column("word").to_pylist(), part) if p < 0]
    return _model(plain, chance, [known[i] for i in order])


def _rows(part: np.ndarray, key: np.ndarray, n: np.ndarray, word: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(n), pa.array(word or [None] * len(part), pa.binary())],
        ["part", "key", "n", "word"])


def _counted(items: list[bytes], room: int) -> np.ndarray:
    return np.bincount(_contexts(*_packed(items))[0] % room, minlength=room)


def _model(plain: np.ndarray, chance: np.ndarray, parts: list[bytes]) -> Model:
    usual = [plain, *(_counted(x, _SIZE ** 3) for x in _identifiers(parts, SEED))]
    usual = [_back_off(n.reshape(_SIZE, _SIZE, _SIZE)).ravel() for n in usual]
    pairs = [_back_off((n + _counted(x, _SIZE ** 2)).reshape(_SIZE, _SIZE)).ravel() for n, x in zip(chance, _draws(SEED))]
    model = Model(*(np.rint(np.array(x) * UNIT) for x in (pairs, usual)), 0.0)
    random = [x for drawn in _draws(SEED + 1) for x in drawn]
    ordinary = [x for made in _identifiers(parts, SEED + 1) for x in made]
    scores = model.score(*_packed([*random, *ordinary]))
    model.cut = -best_cut(-scores, np.append(np.zeros(len(random)), np.ones(len(ordinary))), HARM)
    return model


def scan(docs: DataFrame, model: Model, text: str = "text", name: str = "secrets") -> DataFrame:
    """The rows with a column ``name``: kind, start, end and score of every secret, by start, then kind in the order of ``KINDS``.

    Positions are code points of the whole text, end exclusive; a pattern's secret is the whole match and scores null. The models
    judge maximal strings of ``CHARS`` of at least ``LEAST`` that no pattern's match touches. Null and empty texts have no
    secrets; rows are independent, so repeated rows have equal results and an empty table gives no rows. A column that
    is called like ``name`` stays, the new one gets another name.
    """
    name, columns = fresh(docs.columns, name), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = base_matches(part.column(text))
            starts, lengths, taken = strings(found)
            some = ~taken & (lengths >= LEAST)
            starts, lengths = starts[some], lengths[some]
            score = sent.value.score(found.data, starts, lengths) if len(starts) else np.zeros(0, np.int64)
            hit = score > sent.value.cut
            kind = np.append(found.kind, np.full(hit.sum(), 3))
            start, end = np.append(found.start, starts[hit]), np.append(found.end, (starts + lengths)[hit])
            value = np.append(np.full(len(found.kind), np.nan), score[hit] / UNIT)
            order = np.lexsort((kind, start))
            kind, start, end, value = kind[order], start[order], end[order], value[order]
            row = np.searchsorted(found.ends, start, side="right") - 1
            points = np.append(0, np.cumsum((found.data & 0xC0) != 0x80))
            base = points[found.ends[row]]
            out = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(points[start] - base), pa.array(points[end] - base),
                 pa.array(value, from_pandas=True)], ["kind", "start", "end", "score"])
            upto = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(upto), out)], [*columns, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{kinds}, `{name}` {SECRETS}")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs)).drop("text")
    spans = lambda rows: F.expr(f"concat_ws(',', transform({rows}, s -> concat_ws(':', s.kind, s.start, s.end)))")
    counts = [F.expr(f"size(filter(secrets, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(spans("filter(secrets, s -> s.kind <> 'markov')"), 256).alias("base_sha256"), spans("secrets").alias("spans"))
