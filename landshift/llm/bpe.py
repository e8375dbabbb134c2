"""Byte-level BPE encoding and decoding over padded numpy matrices (operator 10).

Texts are cut into pieces; the distinct pieces of a slice are put into matrices by length. In each
round every row merges its leftmost pair of least rank; pair ranks come from an open-addressing hash
table, the merged column is squeezed out, and rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from landshift.llm.arrow import map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import PieceMemory, cut

#: Matrix widths in bytes; longer pieces are merged one by one with a heap, in n log n steps.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] < 0
            slot, first = np.unique(at[rest[free]], return_index=True)
            put = rest[free][first]
            self.keys[slot], self.ranks[slot] = keys[put], rank[put]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where there is no such pair (an id of -1 is in none)."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -1
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        rest = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out


class Vocabulary:
    """Ranks of a file of base64 tokens and numbers; rank and id are the same."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.table = PairTable(left, right, rank.astype(np.int32))
        by_id = {r: t for t, r in self.ranks.items()}
        sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.token_length, self.token_start = sizes, np.cumsum(sizes) - sizes
        self.memory = PieceMemory(self.encode)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces on end and the number of ids of each; a piece that is a token is that token."""
        known = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        counts = (known >= 0).astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.flatnonzero(known >= 0)
        done.append((whole, counts[whole], known[whole]))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo, low = known < 0, 0
        for width in WIDTHS:
            rows = np.flatnonzero(todo & (sizes > low) & (sizes <= width))
            for part in np.array_split(rows, max(1, -(-len(rows) * width // CELLS))):
                if len(part):
                    done += self._merge(part, [pieces[i] for i in part.tolist()], sizes[part], width)
            low = width
        for i in np.flatnonzero(todo & (sizes > low)).tolist():
            ids = np.array(self._merge_long(pieces[i]), np.int64)
            done.append((np.array([i]), np.array([len(ids)]), ids))
        rows, lengths, flat = (np.concatenate(x) for x in zip(*done))
        counts[rows] = lengths
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[ragged(at[rows], lengths)] = flat
        return out, counts

    def _merge(self, rows: np.ndarray, pieces: list[bytes], sizes: np.ndarray, width: int) -> list:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_id[raw], np.int32(-1))
        ranks = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        done = []
        while True:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ids)), at]
            over = least == NONE
            if over.any():
                held = ids[over]
                done.append((rows[over], (held >= 0).sum(axis=1), held[held >= 0].astype(np.int64)))
                keep = ~over
                rows, ids, ranks, at, least = rows[keep], ids[keep], ranks[keep], at[keep], least[keep]
            n, w = ids.shape
            if not n:
                return done
            line = np.arange(n)
            ids[line, at] = least
            stay = np.ones((n, w), bool)
            stay[line, at + 1] = False
            ids = ids[stay].reshape(n, w - 1)
            if w == 2:
                done.append((rows, np.ones(n, np.int64), ids[:, 0].astype(np.int64)))
                return done
            stay = np.ones((n, w - 1), bool)
            stay[line, at] = False
            ranks = ranks[stay].reshape(n, w - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            ranks[before, at[before] - 1] = self.table.get(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.table.get(ids[after, at[after]], ids[after, at[after] + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap of pair ranks and a linked list; a merged neighbour is an empty part."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if parts[i] else -1
            if j < 0 or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (r := self.ranks.get(parts[a] + parts[right[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.ranks[p] for p in parts if p]

    def texts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts on end and the number of ids up to each text's end."""
        return self.memory.tokens(data, *cut(data, ends))

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids on end and the number of bytes up to each text's end."""
        sizes = self.token_length[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.token_bytes[ragged(self.token_start[ids], sizes)], total[upto]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, vocab: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every row. A null or empty text has no ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for part in slices(batches, text):
            ids, upto = v.texts(*text_bytes(part.column(text)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(id_col), lists], [id_col, "ids"])

    return map_batches(docs.select(id_col, text), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocab: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows of ids; bytes that are no UTF-8 become replacement characters."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for part in batches:
            lists = part.column("ids").fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            data, ends = v.decode(ids, upto)
            raw, at = data.tobytes(), np.append(0, ends).tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, vocab: str, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the bytes decoded from them, and the ids.

    One row per input row, repeated rows included; a null text counts as empty, a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for part in slices(batches, text):
            ids, upto = v.texts(*text_bytes(part.column(text)))
            back, ends = v.decode(ids, upto)
            raw, plain = ids.astype("<u4").tobytes(), back.tobytes()
            at, to = np.append(0, upto * 4).tolist(), np.append(0, ends).tolist()
            yield pa.RecordBatch.from_arrays([
                part.column(id_col),
                pa.array(np.diff(np.append(0, upto)), pa.int64()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(to, to[1:])], pa.string()),
                *(pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), pa.array(ids.astype(np.int32))) for _ in more),
            ], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *more])

    return map_batches(docs.select(id_col, text),
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab)
