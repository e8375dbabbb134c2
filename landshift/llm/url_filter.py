"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join (operator 6).

A list entry is a canonical host with a path prefix. A URL is looked up under every host suffix at a
label border and every path prefix whose length some entry has. The filter has a fixed size, so it
can be sent to every task however long the list is; a fuller filter only passes more false hits,
and the join by the entry itself removes those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.llm.arrow import map_batches
from landshift.session import cut_lineage

#: Blocks of 512 bits; 2 ** 14 blocks are 1 MB.
BLOCKS = 1 << 14
BITS_PER_KEY = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of every key, and its bits as eight 64-bit words."""
    h = np.fromiter((xxhash.xxh3_128_intdigest(k) & 0xFFFFFFFFFFFFFFFF for k in keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    words = np.zeros((len(keys), 8), np.uint64)
    a, b = h & np.uint64(0xFFFF), ((h >> np.uint64(16)) & np.uint64(0xFFFF)) | np.uint64(1)
    rows = np.arange(len(keys))
    for i in range(BITS_PER_KEY):
        bit = (a + np.uint64(i) * b) & np.uint64(511)
        words[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block, words


def bloom(keys: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """Filter (blocks x 8 words) of column ``key``; bits are combined by block before they are collected."""
    names = [f"w{i}" for i in range(8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, words = _bits([k for k in batch.column("key").to_pylist() if k is not None], blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), *[pa.array(words[:, i].astype(np.int64)) for i in range(8)]], ["block", *names])

    rows = map_batches(keys.select("key"), run, "block long, " + ", ".join(f"{n} long" for n in names))
    found = rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names]).collect()
    out = np.zeros((blocks, 8), np.uint64)
    for row in found:
        out[row["block"]] = np.array(row[1:], np.int64).astype(np.uint64)
    return out


def may_hold(table: np.ndarray, keys: list[str]) -> np.ndarray:
    block, words = _bits(keys, len(table))
    return ((table[block] & words) == words).all(axis=1)


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def match(urls: DataFrame, entries: DataFrame, url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """(url, host, path, rule, verdict) of every distinct URL; rule and verdict are null without a fitting entry.

    ``entries``: host, path, verdict. The longest fitting entry wins; of entries of equal length the
    one with the longer host, then the lesser verdict. Null URLs and URLs without ``://`` have an
    empty host and path.
    """
    rules = cut_lineage(entries.select("host", "path", "verdict", F.concat("host", "path").alias("key")).distinct())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    table = urls.sparkSession.sparkContext.broadcast(bloom(rules, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys = [[s + p[:n] for s in _suffixes(h) for n in lengths if n <= len(p)] for h, p in zip(hosts, paths)]
            hit = may_hold(table.value, [k for x in keys for k in x])
            at, held = 0, []
            for x in keys:
                held.append([k for k, ok in zip(x, hit[at:at + len(x)]) if ok])
                at += len(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(held, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    distinct = urls.groupBy(F.col(url).alias("url")).agg(F.lit(1).alias("_one")).select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = map_batches(distinct, run, "url string, host string, path string, keys array<string>")
    hits = judged.select("url", "host", "path", F.explode_outer("keys").alias("key"))
    rule = rules.select("key", F.struct(
        F.length("key").alias("n"), F.length("host").alias("h"), F.col("key").alias("rule"), F.col("verdict")).alias("r"))
    return (
        hits.join(rule, "key", "left").groupBy("url", "host", "path").agg(F.max("r").alias("r"))
        .select("url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))


def judge(
    pages: DataFrame, entries: DataFrame, default: str = "allow", url: str = "url", id_col: str = "page_id",
    blocks: int = BLOCKS,
) -> DataFrame:
    """Per row: id, host, path, rule, verdict; a URL that no entry fits has the default verdict.

    Repeated rows and repeated URLs are judged alike, an empty list judges by the default, and no
    columns but the id and the URL are read.
    """
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url).alias("url"))
    known = match(rows, entries, "url", blocks).withColumnRenamed("url", "_url")
    return rows.join(known, F.col("url").eqNullSafe(F.col("_url"))).select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(pd.DataFrame(RULES, columns=["host", "path", "verdict"]))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), entries)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, p.host, p.path,
  (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM r
    WHERE (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)) AS rule,
  coalesce((SELECT max_by(r.verdict, length(r.host || r.path)) FROM r
    WHERE (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path)), 'allow') AS verdict
FROM p
"""
