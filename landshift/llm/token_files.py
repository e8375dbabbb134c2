"""Token ids in seekable Zstandard files (operator 8).

A file is a run of independent Zstandard frames of little-endian unsigned 32-bit ids, cut at document
borders. Two skippable frames follow: the document index (compressed ids and token counts), and last
the seek table of the public Zstandard seekable format with a checksum of every frame. A reader takes
the tail of the file and then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landshift.llm.arrow import SLICE_BYTES, map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import PieceMemory, cut
from landshift.session import cut_lineage, scratch_path

FRAME_IDS = 1 << 16
# Fixed values of the public Zstandard frame and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG, FOOTER, ENTRY = 0x80, 9, 12
NO_ID = np.iinfo(np.int64).min


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


class Writer:
    """Appends frames to a stream; ``close`` adds the index and the seek table."""

    def __init__(self, out):
        self.out, self.frames = out, []
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.size = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids on end; a frame ends with the document that fills it."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<u4"))
        ends = np.cumsum(counts)
        at = 0
        while True:
            stop = int(np.searchsorted(ends, at + FRAME_IDS - self.size))
            if stop >= len(ends):
                break
            self.held.append(ids[at:ends[stop]])
            at = int(ends[stop])
            self._flush()
        self.held.append(ids[at:])
        self.size += len(ids) - at

    def _flush(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes() if self.held else b""
        self.held, self.size = [], 0
        if raw:
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        doc_ids = np.concatenate(self.doc_ids) if self.doc_ids else np.zeros(0, "<i8")
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, "<u4")
        index = self.pack.compress(doc_ids.tobytes() + counts.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *x) for x in entries)
        table += struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Reads the tail of a file, then frames on demand; a wrong checksum is an error."""

    def __init__(self, stream):
        self.stream = stream
        self.unpack = zstandard.ZstdDecompressor()
        size = stream.seek(0, 2) or stream.tell()
        count, _, magic = struct.unpack("<IBI", self._at(size - FOOTER, FOOTER))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        raw = self._at(size - FOOTER - count * ENTRY, count * ENTRY)
        self.table = np.frombuffer(raw, "<u4").reshape(count, 3).astype(np.int64)
        self.offset = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        packed = self._at(int(self.offset[-1]) + 8, int(self.table[-1, 0]) - 8)
        self._check(packed, count - 1)
        index = self.unpack.decompress(packed, max_output_size=1 << 40) if packed else b""
        n = len(index) // 12
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.counts = np.frombuffer(index, "<u4", n, 8 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_start = (np.cumsum(self.table[:-1, 1]) - self.table[:-1, 1]) // 4

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def _check(self, raw: bytes, frame: int) -> None:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[frame, 2]:
            raise ValueError(f"frame {frame}: its checksum doesn't fit")

    def frame(self, i: int) -> np.ndarray:
        packed = self._at(int(self.offset[i]), int(self.table[i, 0]))
        raw = self.unpack.decompress(packed, max_output_size=int(self.table[i, 1]))
        self._check(raw, i)
        return np.frombuffer(raw, "<u4")

    def frames(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids on end) of every frame."""
        ends = self.starts + self.counts
        at = 0
        for i in range(len(self.table) - 1):
            ids = self.frame(i)
            stop = int(np.searchsorted(ends, self.frame_start[i] + len(ids), side="right"))
            yield at, stop, ids
            at = stop

    def get(self, doc_ids: list[int]) -> dict[int, np.ndarray]:
        """Ids of the wanted documents; only frames that hold one of them are decompressed."""
        rows = np.flatnonzero(np.isin(self.doc_ids, doc_ids))
        held = np.searchsorted(self.frame_start, self.starts[rows], side="right") - 1
        found = {}
        for f in np.unique(held).tolist():
            ids = self.frame(f)
            for r in rows[held == f].tolist():
                a = int(self.starts[r] - self.frame_start[f])
                found[int(self.doc_ids[r])] = ids[a:a + int(self.counts[r])]
        return found


@cache
def _pieces(vocab: str) -> PieceMemory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(vocab)
    split = tokenizer.pre_tokenizer
    if isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None:
        # a piece needs no more cutting: its bytes, written in the byte alphabet, go straight to the merges
        model, letters = tokenizer.model, _byte_letters()

        def ids_of(piece: bytes) -> list[int]:
            return [t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))]
    else:
        raise ValueError(f"{vocab} does not cut texts into the pieces of the byte-level pattern")

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [ids_of(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    return PieceMemory(encode, 400_000)


@cache
def _added(vocab: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """Pattern and ids of the file's added tokens: a text is cut at them before anything else, as the library does."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(vocab).get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()):
        raise ValueError(f"{vocab} has added tokens that take blanks with them")
    ids = {t.content.encode(): i for i, t in tokens.items()}
    longest = sorted(ids, key=len, reverse=True)
    return (re.compile(b"|".join(map(re.escape, longest))) if ids else None), ids


def token_ids(memory: PieceMemory, vocab: str, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts on end and their number up to each text's end; strings of added tokens are these tokens."""
    pattern, known = _added(vocab)
    raw = data.tobytes() if pattern is not None else b""
    found = [(a + int(s), b + int(s), known[raw[a + s:b + s]]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())
             for a, b in (m.span() for m in pattern.finditer(raw[s:e]))] if pattern is not None and pattern.search(raw) else []
    if not found:
        return memory.tokens(data, *cut(data, ends))
    start, stop, token = (np.array(x, np.int64) for x in zip(*found))
    bounds = np.unique(np.concatenate([ends, start, stop]))
    special = np.isin(bounds[:-1], start)
    rest = np.ones(len(data), bool)
    rest[ragged(start, stop - start)] = False
    plain = np.append(0, np.cumsum(np.where(special, 0, np.diff(bounds))))
    data = data[rest]
    ids, upto = memory.tokens(data, *cut(data, plain))
    counts = np.where(special, 1, np.diff(np.append(0, upto)))
    out = np.empty(int(counts.sum()), np.uint32)
    own = np.repeat(special, counts)
    out[own], out[~own] = token, ids
    return out, np.append(0, np.cumsum(counts))[np.searchsorted(bounds, ends[1:])]


def _byte_letters() -> dict[int, str]:
    """The letter of every byte in byte-level vocabularies: itself where it prints, else the next above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def write(docs: DataFrame, vocab: str, end_id: int, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Token files in ascending id order under ``folder``; returns their stored manifest.

    Manifest: part, path, n_docs, n_tokens, start (ids in all files before). A retried task writes
    under a new name, and only the file of the attempt that Spark commits is in the manifest.
    Null ids come first; rows of one id are ordered by a hash of their text; a null text has only
    the end id.
    """
    where = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        memory = _pieces(vocab)
        target = f"{where}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, path = _filesystem(target)
        n_docs = n_tokens = 0
        writer = out = None
        for chunk in slices(batches, text, 2 * SLICE_BYTES):
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                writer = Writer(out)
            data, ends = text_bytes(chunk.column(text))
            ids, upto = token_ids(memory, vocab, data, ends)
            counts = np.diff(np.append(0, upto))
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            whole[ragged(np.cumsum(counts + 1) - counts - 1, counts)] = ids
            keys = chunk.column(id_col).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            writer.add(keys, counts + 1, whole)
            n_docs, n_tokens = n_docs + len(counts), n_tokens + len(whole)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [target], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    tie = F.xxhash64(F.col(text))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    ordered = rows.repartitionByRange(F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)
    files = cut_lineage(map_batches(ordered, run, "part long, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: id, start, n_tokens, crc32 of its ids; every frame's checksum is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, path = _filesystem(target)
                with fs.open_input_file(path) as stream:
                    reader = Reader(stream)
                    for a, b, ids in reader.frames():
                        raw = ids.tobytes()
                        counts = reader.counts[a:b]
                        ends = np.cumsum(counts) * 4
                        at = np.append(0, ends).tolist()
                        keys = reader.doc_ids[a:b]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(keys, pa.int64(), mask=keys == NO_ID),
                            pa.array(start + reader.starts[a:b], pa.int64()),
                            pa.array(counts, pa.int64()),
                            pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64()),
                        ], [id_col, "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return map_batches(manifest.select("path", "start", "part").repartition(n, "part"),
        run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one file, without reading the rest of it."""
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as stream:
        return Reader(stream).get(doc_ids)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, folder))
