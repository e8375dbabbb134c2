"""Line dedup with sharded cuckoo filters over exact reference counts (operator 2).

The exact part is two tables: postings (line key, document) and reference counts (line key, number of
documents, largest document). Keys that enough documents hold are also in cuckoo filters, one per
shard of the key space. A filter answers for most lines that they needn't be looked up; a possible
hit is looked up in the counts. Filters have a fixed size: a shard that takes no more keys says yes
to all. Documents can be added and taken away; both give the index that a fresh build would give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, slices
from landshift.session import cut_lineage

MIN_POINTS, MIN_DOCS = 20, 3
#: 64 shards of 2 ** 13 buckets with four 16-bit slots: 4 MB, for about 1.9 million repeated lines.
SHARDS, BUCKETS, SLOTS = 64, 1 << 13, 4
ROUNDS = 400
BLANK = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]


class Cuckoo:
    """One shard: ``table`` (buckets x slots) of 16-bit fingerprints, 0 for a free slot; None when saturated."""

    def __init__(self, table: np.ndarray | None):
        self.table = table

    @staticmethod
    def empty(buckets: int = BUCKETS) -> Cuckoo:
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16))

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = ((hi.astype(np.uint64) >> np.uint64(20)) % np.uint64(len(self.table))).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.int64) * 0x5BD1E995) >> 7
        return bucket ^ (step & (len(self.table) - 1))

    def may_hold(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(len(hi), bool)
        mark, a, b = self._places(hi, lo)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Keys that aren't held yet. All pending marks move at once; a mark without room takes a held one's slot."""
        if self.table is None or not len(hi):
            return
        mark, at, _ = self._places(hi, lo)
        mark, at = self._settle(mark, at)
        at = self._other(at, mark)
        for turn in range(ROUNDS):
            mark, at = self._settle(mark, at)
            if not len(mark):
                return
            _, one = np.unique(at, return_index=True)
            slot = (turn + mark[one]) % SLOTS
            held = self.table[at[one], slot].copy()
            self.table[at[one], slot] = mark[one]
            mark[one] = held
            at[one] = self._other(at[one], held)
        self.table = None

    def _settle(self, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts marks into free slots of their buckets; gives back those without room."""
        order = np.argsort(at, kind="stable")
        mark, at = mark[order], at[order]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        free = np.argsort(self.table[at] != 0, axis=1, kind="stable")
        room = (self.table[at] == 0).sum(axis=1)
        fits = place < room
        self.table[at[fits], free[fits, place[fits]]] = mark[fits]
        return mark[~fits], at[~fits]

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Keys that are held; each takes one of its fingerprints out."""
        if self.table is None:
            return
        for mark, *buckets in zip(*(x.tolist() for x in self._places(hi, lo))):
            for b in buckets:
                slots = np.flatnonzero(self.table[b] == mark)
                if len(slots):
                    self.table[b, slots[0]] = 0
                    break


def line_keys(line: bytes) -> bytes | None:
    """Key of a line (stripped, A-Z lowered); None where it is shorter than 20 code points."""
    key = line.strip(BLANK).lower()
    if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS):
        return None
    return key


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc): one row per key and document, keys as 128-bit hashes; rows of one id are one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches, text):
            found: list[bytes] = []
            counts = []
            for value in part.column(text):
                keys = {digest(k) for line in (value.as_py() or "").encode().split(b"\n") if (k := line_keys(line)) is not None}
                found += keys
                counts.append(len(keys))
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), part.column(id_col).take(pa.array(rows))], ["hi", "lo", "doc"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    return map_batches(rows, run, "hi long, lo long, doc long")


def reference_counts(posted: DataFrame) -> DataFrame:
    """(hi, lo, refs, holder) of (hi, lo, doc): documents that hold the key, and the largest of them.

    Grouped by key and document first, so a line that every document holds is spread over all tasks;
    a null document counts as one and is the least.
    """
    once = posted.groupBy("hi", "lo", "doc").agg(F.lit(1).alias("_one"))
    return once.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.max("doc").alias("holder"))


def build_filters(keys: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """(shard, slots binary) of (hi, lo); null slots: saturated. A shard's work is bounded by its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Cuckoo] = {}
        for batch in batches:
            hi, lo, shard = (batch.column(c).to_numpy() for c in ("hi", "lo", "shard"))
            for s in np.unique(shard).tolist():
                held.setdefault(s, Cuckoo.empty(buckets)).insert(hi[shard == s], lo[shard == s])
        yield _rows(held)

    rows = keys.select("hi", "lo", F.pmod("hi", F.lit(shards)).alias("shard"))
    return map_batches(rows.repartition(min(shards, 16), "shard"), run, "shard long, slots binary")


def _rows(held: dict[int, Cuckoo]) -> pa.RecordBatch:
    slots = [None if c.table is None else c.table.tobytes() for c in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(slots, pa.binary())], ["shard", "slots"])


def change_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Filters after keys came and went; only changed shards are rewritten, each on its own."""
    keys = added.select("hi", "lo", F.lit(1).alias("add")).unionByName(removed.select("hi", "lo", F.lit(-1).alias("add")))
    keys = keys.withColumn("shard", F.pmod("hi", F.lit(shards)))
    old = filters.select(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(0).alias("add"), "shard", "slots")
    rows = old.unionByName(keys.withColumn("slots", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Cuckoo] = {}
        for batch in batches:
            hi, lo, add, shard = (batch.column(c).to_numpy() for c in ("hi", "lo", "add", "shard"))
            for i in np.flatnonzero(add == 0).tolist():
                raw = batch.column("slots")[i].as_py()
                held[int(shard[i])] = Cuckoo(None if raw is None else np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())
            for s in np.unique(shard[add != 0]).tolist():
                c = held.setdefault(s, Cuckoo.empty(buckets))
                gone, new = (shard == s) & (add < 0), (shard == s) & (add > 0)
                c.delete(hi[gone], lo[gone])
                c.insert(hi[new], lo[new])
        yield _rows(held)

    return map_batches(rows.repartition(min(shards, 16), "shard").sortWithinPartitions("shard", F.abs("add")),
        run, "shard long, slots binary")


def possible_hits(posted: DataFrame, filters: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Postings whose key a filter may hold. The filters sent to the tasks have a fixed size in all."""
    tables: list[Cuckoo] = [Cuckoo.empty(buckets) for _ in range(shards)]
    for row in filters.collect():
        raw = row["slots"]
        tables[row["shard"]] = Cuckoo(None if raw is None else np.frombuffer(raw, np.uint16).reshape(-1, SLOTS))
    sent = posted.sparkSession.sparkContext.broadcast([c.table for c in tables])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuckoos = [Cuckoo(t) for t in sent.value]
        full = np.array([c.table is None for c in cuckoos])
        # shards lie on end in one table, so that a batch is looked up at once
        whole = np.concatenate([np.zeros((buckets, SLOTS), np.uint16) if c.table is None else c.table for c in cuckoos])
        for batch in batches:
            hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
            shard = np.mod(hi, shards)
            mark, a, b = cuckoos[int(np.argmin(full))]._places(hi, lo) if not full.all() else (None, None, None)
            if mark is None:
                yield batch
                continue
            a, b = a + shard * buckets, b + shard * buckets
            hit = full[shard] | (whole[a] == mark[:, None]).any(axis=1) | (whole[b] == mark[:, None]).any(axis=1)
            yield batch.filter(pa.array(hit))

    return map_batches(posted.select("hi", "lo", "doc"), run, "hi long, lo long, doc long")


def dropped_lines(posted: DataFrame, repeated: DataFrame, filters: DataFrame) -> DataFrame:
    """(doc, keys): the keys whose lines a document loses, as structs of its two halves."""
    hits = possible_hits(posted, filters)
    exact = hits.join(repeated.select("hi", "lo", "holder"), KEY).where(
        F.col("doc").isNull() | (F.col("doc") < F.col("holder")))
    lost = exact.select("doc", F.struct("hi", "lo").alias("key"))
    return lost.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def apply(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "_lines") -> DataFrame:
    """The documents with their texts cut, and a struct ``name``: n_lines, n_dropped, kept_sha256."""
    columns = docs.columns
    doc_name, hi_name, lo_name = (fresh(columns, f"_lost_{x}") for x in ("doc", "hi", "lo"))
    lost = lost.select(F.col("doc").alias(doc_name), F.col("keys.hi").alias(hi_name), F.col("keys.lo").alias(lo_name))
    rows = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col(doc_name)), "left").drop(doc_name)
    at = columns.index(text)
    stats = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in slices(batches, text):
            kept, n_lines, n_lost, sums = [], [], [], []
            for value, hi, lo in zip(part.column(text), part.column(hi_name), part.column(lo_name)):
                whole = (value.as_py() or "").encode()
                n = whole.count(b"\n") + 1
                if hi.is_valid:
                    keys = _digests(hi, lo)
                    lines = [x for x in whole.split(b"\n") if (k := line_keys(x)) is None or digest(k) not in keys]
                    n_lost.append(n - len(lines))
                    whole = b"\n".join(lines)
                else:
                    n_lost.append(0)
                n_lines.append(n)
                kept.append(whole.decode())
                sums.append(hashlib.sha256(whole).hexdigest())
            out = [part.column(c) for c in columns]
            out[at] = pa.array(kept, pa.string())
            found = pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64()), pa.array(sums, pa.string())], fields=list(stats))
            yield pa.RecordBatch.from_arrays([*out, found], [*columns, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return map_batches(rows, run, ", ".join([*kinds, f"`{name}` struct<n_lines: long, n_dropped: long, kept_sha256: string>"]))


def _digests(hi: pa.Scalar, lo: pa.Scalar) -> set[bytes]:
    both = np.column_stack([hi.values.to_numpy(), lo.values.to_numpy()]).astype("<i8").tobytes()
    return {both[i:i + 16] for i in range(0, len(both), 16)}


@dataclass
class LineIndex:
    """Postings, counts and filters as stored tables; every change gives a new index and leaves the old one."""

    posted: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS

    @staticmethod
    def build(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text") -> LineIndex:
        posted = cut_lineage(postings(docs, id_col, text).distinct())
        counts = cut_lineage(reference_counts(posted))
        return LineIndex(posted, counts, cut_lineage(build_filters(counts.where(F.col("refs") >= min_docs))), min_docs)

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> LineIndex:
        """With more documents; an id that is there already gains the lines it doesn't have yet."""
        same = [self.posted[c].eqNullSafe(F.col(f"_{c}")) for c in ("hi", "lo", "doc")]
        new = postings(docs, id_col, text).distinct()
        new = cut_lineage(new.select(*[F.col(c).alias(f"_{c}") for c in new.columns]).join(
            self.posted, same[0] & same[1] & same[2], "left_anti").toDF("hi", "lo", "doc"))
        counts = cut_lineage(
            self.counts.unionByName(reference_counts(new)).groupBy(*KEY)
            .agg(F.sum("refs").alias("refs"), F.max("holder").alias("holder")))
        return self._changed(cut_lineage(self.posted.unionByName(new)), counts)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without some documents; counts are made anew for the keys that these held."""
        gone_ids = ids.select(F.col(id_col).cast("long").alias("_gone")).distinct()
        match = F.col("doc").eqNullSafe(F.col("_gone"))
        touched = cut_lineage(self.posted.join(gone_ids, match, "left_semi").select(*KEY).distinct())
        posted = cut_lineage(self.posted.join(gone_ids, match, "left_anti"))
        again = reference_counts(posted.join(touched, KEY, "left_semi"))
        return self._changed(posted, cut_lineage(self.counts.join(touched, KEY, "left_anti").unionByName(again)))

    def _changed(self, posted: DataFrame, counts: DataFrame) -> LineIndex:
        now, before = counts.where(F.col("refs") >= self.min_docs).select(*KEY), self.repeated().select(*KEY)
        filters = change_filters(
            self.filters, now.join(before, KEY, "left_anti"), before.join(now, KEY, "left_anti"))
        return LineIndex(posted, counts, cut_lineage(filters), self.min_docs)

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "_lines") -> DataFrame:
        return apply(docs, dropped_lines(self.posted, self.repeated(), self.filters), id_col, text, name)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text", name: str = "_lines") -> DataFrame:
    """One pass over a whole table, without keeping an index for later.

    A null or empty text is one empty line; rows of one id are one document and lose the same lines;
    an empty table gives no rows; other columns pass through. Only keys held by ``min_docs``
    documents are stored from the counts. A column that is called like ``name`` stays, the new one gets another name.
    """
    name = fresh(docs.columns, name)
    posted = cut_lineage(postings(docs, id_col, text))
    repeated = cut_lineage(reference_counts(posted).where(F.col("refs") >= min_docs))
    return apply(docs, dropped_lines(posted, repeated, build_filters(repeated)), id_col, text, name)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "_lines.n_lines", "_lines.n_dropped", "_lines.kept_sha256")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), k AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.*, r.holder IS NOT NULL AND k.doc_id < r.holder AS lost FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
