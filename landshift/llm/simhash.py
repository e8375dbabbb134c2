"""SimHash near-duplicates through Golay-code fuzzy hashing (operator 4).

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code puts every
23-bit word within three bits of exactly one codeword, and within four bits of one or of six. Of two
fingerprints that differ in three bits at most, two of the three segments differ in one bit at most, so
for some pair of segments the nearest codewords of the one are among the keys of the other. A
fingerprint is stored under its nearest codewords and looked up under all its keys; what meets is
compared bit by bit, and large crowds of unlike fingerprints under one key give a spanning forest of
their links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import words
from landshift.operators.components import connected_components
from landshift.session import cut_lineage

# Fixed values of the public XXH64 hash, and the generator polynomial of the binary Golay code.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
GOLAY = 0xC75

SEED, SHINGLE, RADIUS = 42, 3, 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Hashes whose bits are unpacked at once, and the crowd from which a key's links are found by search.
BLOCK, CROWD = 1 << 17, 64


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _u(P2), 31) * _u(P1)


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every byte range of ``data``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,)).copy()
    n = lengths.astype(np.uint64)
    h = np.full(len(starts), _u(seed + P5), np.uint64)
    at = starts.copy()
    left = lengths.copy()
    rows = np.flatnonzero(left >= 32)
    if len(rows):
        v = [np.full(len(rows), _u(seed + x), np.uint64) for x in (P1 + P2, P2, 0, -P1)]
        on = np.arange(len(rows))
        while len(on):
            for i in range(4):
                v[i][on] = _round(v[i][on], lanes[at[rows[on]] + 8 * i])
            at[rows[on]] += 32
            left[rows[on]] -= 32
            on = on[left[rows[on]] >= 32]
        long = sum(_rot(x, r) for x, r in zip(v, (1, 7, 12, 18)))
        for x in v:
            long = (long ^ _round(np.zeros_like(x), x)) * _u(P1) + _u(P4)
        h[rows] = long
    h += n
    while len(rows := np.flatnonzero(left >= 8)):
        h[rows] = _rot(h[rows] ^ _round(np.zeros(len(rows), np.uint64), lanes[at[rows]]), 27) * _u(P1) + _u(P4)
        at[rows] += 8
        left[rows] -= 8
    rows = np.flatnonzero(left >= 4)
    h[rows] = _rot(h[rows] ^ ((lanes[at[rows]] & _u(0xFFFFFFFF)) * _u(P1)), 23) * _u(P2) + _u(P3)
    at[rows] += 4
    left[rows] -= 4
    while len(rows := np.flatnonzero(left > 0)):
        h[rows] = _rot(h[rows] ^ ((lanes[at[rows]] & _u(0xFF)) * _u(P5)), 11) * _u(P1)
        at[rows] += 1
        left[rows] -= 1
    h = (h ^ (h >> np.uint64(33))) * _u(P2)
    h = (h ^ (h >> np.uint64(29))) * _u(P3)
    return h ^ (h >> np.uint64(32))


def fingerprints(data: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of every text; a bit is 1 where over half of the shingle hashes have it."""
    starts, lengths, upto = words(data, ends)
    out = np.zeros(len(upto), np.uint64)
    if not len(starts):
        return out
    # the words again with one blank between them, A-Z lowered
    size = lengths + 1
    begin = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    joined[ragged(begin, lengths)] = data[ragged(starts, lengths)]
    joined[(joined >= 65) & (joined <= 90)] += 32
    counts = np.diff(np.append(0, upto))
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = ragged((upto - counts), shingles)
    last = np.minimum(first + shingle, np.repeat(upto, shingles)) - 1
    h = xxh64(joined, begin[first], begin[last] + lengths[last] - begin[first])
    total = np.zeros((len(upto), 64), np.int64)
    of = np.repeat(np.arange(len(upto)), shingles)
    for a in range(0, len(h), BLOCK):
        part, texts = h[a:a + BLOCK], of[a:a + BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
        total[texts[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    major = 2 * total > shingles[:, None]
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits, and per syndrome the error patterns of at most four bits (-1: none)."""
    remainder = np.zeros(1 << 12, np.int64)
    for m in range(1 << 12):
        x = m << 11
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        remainder[m] = x
    patterns = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = remainder[e >> 11] ^ (e & 0x7FF)
            patterns[s, used[s]] = e
            used[s] += 1
    return remainder, patterns


def codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (rows x 6) of the codewords within four bits of 23-bit words, the nearest first; -1: none."""
    remainder, patterns = _golay()
    errors = patterns[remainder[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def candidate_words(segment: np.ndarray, doubt: np.ndarray, most: int) -> np.ndarray:
    """Indices (rows x ``most``) of those codewords within four bits whose differing bits add up to the least ``doubt``
    (rows x 23: how clear each bit is), the least first; -1: none."""
    remainder, patterns = _golay()
    errors = patterns[remainder[segment >> 11] ^ (segment & 0x7FF)]
    cost = np.zeros(errors.shape, np.int64)
    for bit in range(23):
        cost += (errors >> bit & 1) * doubt[:, bit:bit + 1]
    order = np.argsort(np.where(errors < 0, np.iinfo(np.int64).max, cost), axis=1, kind="stable")[:, :most]
    errors = np.take_along_axis(errors, order, axis=1)
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, stored) of fingerprints: all keys of every pair of segments; stored: made of both nearest codewords."""
    found = [codewords((prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    out = []
    for pair, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        key = np.where(
            (found[a][:, :, None] >= 0) & (found[b][:, None, :] >= 0),
            pair << 24 | found[a][:, :, None] << 12 | found[b][:, None, :], -1).reshape(len(prints), -1)
        row, col = np.nonzero(key >= 0)
        out.append((key[row, col], row, col == 0))
    return tuple(np.concatenate(x) for x in zip(*out))


def links_of_runs(key: np.ndarray, prints: np.ndarray, stored: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints under one key; rows are sorted by key."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    crowd = size > CROWD
    few = np.flatnonzero(np.repeat((size > 1) & ~crowd, size) & stored)
    group = np.searchsorted(begin, few, side="right") - 1
    left = [np.zeros(0, np.uint64)]
    right = [np.zeros(0, np.uint64)]
    for a in range(0, len(few), 1 << 14):
        g = group[a:a + (1 << 14)]
        x = np.repeat(prints[few[a:a + (1 << 14)]], size[g])
        y = prints[ragged(begin[g], size[g])]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        left.append(x[near])
        right.append(y[near])
    for g in np.flatnonzero(crowd).tolist():
        x, y = forest(np.unique(prints[begin[g]:begin[g] + size[g]]), radius)
        left.append(x)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pairs[0], pairs[1]


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined by links of at most ``radius`` bits: one less than each component has members."""
    rest = prints
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            found = rest[near]
            if len(found):
                rest = rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            prints = fingerprints(*text_bytes(part.column(text)), shingle)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(prints.view(np.int64))], [id_col, "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text), run, f"`{id_col}` {kind}, print long")


def print_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) of distinct fingerprints ``print`` that differ in at most ``radius`` bits, or a forest of them."""
    if radius > RADIUS:
        raise ValueError("two of three segments are within one bit only up to three bits in all")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("print").to_numpy().view(np.uint64)
            for a in range(0, len(whole), 1 << 12):
                part = whole[a:a + (1 << 12)]
                key, row, stored = keys(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(stored)], ["key", "print", "stored"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, bool))
        for batch in batches:
            new = (batch.column("key").to_numpy(), batch.column("print").to_numpy().view(np.uint64),
                   batch.column("stored").to_numpy(zero_copy_only=False))
            key, prints, stored = (np.concatenate(x) for x in zip(held, new))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = (key[cut:], prints[cut:], stored[cut:])
            if cut:
                yield _edges(*links_of_runs(key[:cut], prints[:cut], stored[:cut], radius))
        if len(held[0]):
            yield _edges(*links_of_runs(*held, radius))

    rows = map_batches(prints.select("print"), spread, "key int, print long, stored boolean")
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), meet, "src long, dst long")


def _edges(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["src", "dst"])


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (least id reachable by links).

    Null, empty and blank texts have fingerprint zero and are linked like others; equal fingerprints are
    one vertex, so copies cost nothing; null ids get the least other id of their component, or null.
    """
    rows = cut_lineage(fingerprint_rows(docs, id_col, text, shingle))
    vertices = cut_lineage(rows.groupBy("print").agg(F.min(id_col).alias("least")))
    known = connected_components(print_links(vertices, radius))
    joined = vertices.join(known.withColumnRenamed("vertex", "print"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("component"))
    joined = cut_lineage(joined)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("print", "component_id")
    return rows.join(named, "print").select(id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of the least id of every group; rows of one id are one document."""
    name = fresh(docs.columns, "_kept")
    kept = groups(docs, id_col, text, shingle).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
