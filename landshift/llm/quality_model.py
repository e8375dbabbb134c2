"""Quality classifier by importance resampling (operator 9).

Two generative models of hashed n-grams, one of target texts and one of all texts, give every document
a log importance weight. The number of documents to keep follows from a cut between labelled good and
poor documents that took no part in the models, and Gumbel top-k draws that many without replacement, with
chances in proportion to exp(weight / temperature). The temperature is a share of the distance from the cut to the middle good
document, so documents near the cut are drawn by chance and those far from it are nearly certain by their weight.
A document's log weight is tempered by its length: the mean over its n-grams, drawn towards zero for
few of them, times a fixed number. A sum would let a small bias of the models outgrow everything in a
long text. Weights are whole numbers of 1/1024, so they don't depend on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, slices, text_bytes
from landshift.llm.pieces import distinct, windows, words
from landshift.operators.ranking import global_rank
from landshift.session import cut_lineage

#: Buckets of byte trigrams and of shape n-grams (orders 1 to 3).
TEXT_BUCKETS, SHAPE_BUCKETS, UNIT, SMOOTH = 1 << 12, 1 << 12, 1024, 4.0
#: Bound of the labelled rows that the classifier is fitted on; half of them only set the cut.
MAX_LABELLED, FOLDS = 20_000, 2
#: N-grams that a text counts as having besides its own, and the length that a mean is scaled to.
SHRINK, LENGTH = 300, 1000
#: Share of the distance from the cut to the median weight of good labelled documents that is the temperature.
NOISE, SEED = 0.1, 29
SYMBOLS = b"#*$%&|<>"


def _mix(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def _shapes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A small number per word: letter case, symbols, last mark, length class, and whether its pair of words came before."""
    marks = np.zeros((3, 256), np.int32)
    marks[0, 65:91] = 1
    marks[1, list(SYMBOLS)] = 1
    marks[2, 97:123] = marks[2, 128:] = 1
    stop = starts + lengths
    upper, symbol, lower = ((t := np.append(0, np.cumsum(m[data])))[stop] - t[starts] for m in marks)
    last = data[stop - 1].astype(np.int64)
    last[(marks[0] + marks[2])[last] > 0] = 0
    shape = np.minimum(upper, 2) * 3 + np.minimum(lower, 2)
    shape = shape * 3 + np.minimum(symbol, 2)
    shape = shape * 6 + np.minimum(np.log2(lengths).astype(np.int64), 5)
    shape = shape * 256 + last
    _, same = distinct(data, starts, lengths)
    at, pair = windows(same, upto, 2)
    seen = np.zeros(len(starts), np.int64)
    again = np.ones(len(at), bool)
    again[np.unique(pair, return_index=True)[1]] = False
    seen[at[again]] = 1
    return shape * 2 + seen


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams: byte trigrams, then n-grams of word shapes; a bucket belongs to one kind."""
    of_byte = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    wide = data.astype(np.uint64)
    ok = of_byte[2:] == of_byte[:-2] if len(data) > 2 else np.zeros(0, bool)
    tri = (wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:])[ok] if len(data) > 2 else np.zeros(0, np.uint64)
    buckets, texts = [_mix(tri + np.uint64(1), TEXT_BUCKETS)], [of_byte[2:][ok] if len(data) > 2 else of_byte[:0]]
    starts, lengths, upto = words(data, ends)
    if len(starts):
        shape = _shapes(data, starts, lengths, upto).astype(np.uint64)
        of_word = np.repeat(np.arange(len(upto)), np.diff(np.append(0, upto)))
        h = np.zeros(len(shape), np.uint64)
        for n in (1, 2, 3):
            if len(shape) < n:
                break
            h = h[:len(shape) - n + 1] * np.uint64(0x100000001B3) + shape[n - 1:] + np.uint64(n)
            ok = of_word[:len(h)] == of_word[n - 1:]
            buckets.append(_mix(h[ok] + np.uint64(n << 40), SHAPE_BUCKETS) + TEXT_BUCKETS)
            texts.append(of_word[:len(h)][ok])
    return np.concatenate(buckets), np.concatenate(texts)


@dataclass
class Model:
    """Log ratio of target to all texts for every bucket, in 1/1024; None: no labelled texts of that kind."""

    ratio: np.ndarray | None
    cut: float = float("-inf")
    temperature: float = 1.0


def labelled(labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, good) of at most about ``limit`` labelled ids, chosen by a hash; the least label of an id counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("good"))
    n = rows.count()
    share = 1 << 20 if n <= limit else int((1 << 20) * limit / n)
    return rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 20)) < share)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED) -> tuple[Model, dict]:
    """Counts over all texts, and over the labelled good ones of the fitting folds. Returns the labels of the last fold too."""
    known = labelled(labels, limit).toArrow()
    ids, good = known.column("id").to_numpy(), known.column("good").to_numpy()
    order = np.argsort(ids)
    ids, good = ids[order], good[order]
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    target = ids[(good > 0) & (fold > 0)]
    size = TEXT_BUCKETS + SHAPE_BUCKETS
    sent = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for part in slices(batches, text):
            data, ends = text_bytes(part.column(text))
            bucket, of = features(data, ends)
            chosen = np.isin(part.column(id_col).fill_null(-1).to_numpy(), sent.value)
            total[0] += np.bincount(bucket, minlength=size)
            total[1] += np.bincount(bucket[chosen[of]], minlength=size)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    found = map_batches(rows, run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, size))
    at = found.column("bucket").to_numpy()
    counts[0, at], counts[1, at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    held = {int(i): int(g) for i, g, f in zip(ids, good, fold) if f == 0}
    if not counts[1].any():
        return Model(None), held
    # the prior is the raw model, so that a bucket the target never showed loses in proportion to its raw count only
    ratio = np.zeros(size)
    for a, b in ((0, TEXT_BUCKETS), (TEXT_BUCKETS, size)):
        raw = (counts[0, a:b] + SMOOTH) / (counts[0, a:b] + SMOOTH).sum()
        prior = SMOOTH * (b - a)
        goal = (counts[1, a:b] + prior * raw) / (counts[1, a:b].sum() + prior)
        ratio[a:b] = np.log(goal / raw)
    return Model(np.rint(ratio * UNIT).astype(np.int64)), held


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", name: str = "_weight") -> DataFrame:
    """The rows with their tempered log importance weight in 1/1024 (long); a null, empty or one-word text weighs 0 or little."""
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            if sent.value is None:
                weight = np.zeros(part.num_rows, np.int64)
            else:
                bucket, of = features(*text_bytes(part.column(text)))
                total = np.bincount(of, sent.value[bucket], minlength=part.num_rows).astype(np.int64)
                weight = total * LENGTH // (np.bincount(of, minlength=part.num_rows) + SHRINK)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(weight)], [*columns, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{kinds}, `{name}` long")


def best_cut(weights: np.ndarray, good: np.ndarray, harm: float = 5.0) -> float:
    """Cut of least cost (a good document below it costs ``harm``, a poor one above it 1); the middle of its gap."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order] > 0
    cost = np.append(0, np.cumsum(g * harm)) + np.append(np.cumsum((~g)[::-1])[::-1], 0)
    cost[1:-1][w[1:] == w[:-1]] = np.inf
    i = int(np.argmin(cost))
    if i == 0:
        return float(w[0]) - 1
    return float(w[-1]) + 1 if i == len(w) else (float(w[i - 1]) + float(w[i])) / 2


def gumbel_key(weight: Column, id_col: str, temperature: float, seed: int = SEED) -> Column:
    """Log weight over temperature with seeded Gumbel noise; the k largest keys are a sample without replacement."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weight / (UNIT * temperature) - F.log(-F.log(u))


@dataclass
class Sample:
    """The k-th largest key; rows with it or a larger one are in."""

    model: Model
    last: float
    seed: int = SEED

    def keep(self, weight: Column, id_col: str) -> Column:
        return gumbel_key(weight, id_col, self.model.temperature, self.seed) >= F.lit(self.last)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = MAX_LABELLED, seed: int = SEED,
) -> tuple[Sample, DataFrame]:
    """Models, cut and the key of the k-th document; also the stored (id, weight) of every row.

    k: the documents whose weight is above the cut. Without labels of both kinds every document stays.
    Null ids are weighed and drawn like others; rows of one id and text share their fate.
    """
    model, held = train(docs, labels, id_col, text, limit)
    weighed = cut_lineage(weigh(docs.select(F.col(id_col).cast("long").alias("id"), text), model, "id", text).select("id", "_weight"))
    chosen = weighed.sparkSession.sparkContext.broadcast(set(held))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(sorted(chosen.value), np.int64)
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("id").fill_null(-1).to_numpy(), ids)))

    seen = map_batches(weighed, mine, "id long, _weight long").groupBy("id").agg(F.max("_weight").alias("w")).toArrow()
    good = np.array([held[i] for i in seen.column("id").to_pylist()])
    if model.ratio is None or not (0 < (good > 0).sum() < len(good)):
        return Sample(model, float("-inf"), seed), weighed
    held_weights = seen.column("w").to_numpy()
    model.cut = best_cut(held_weights, good)
    model.temperature = max(NOISE * (float(np.median(held_weights[good > 0])) - model.cut), 1.0) / UNIT
    keyed = weighed.select(gumbel_key(F.col("_weight"), "id", model.temperature, seed).alias("key"), (F.col("_weight") > model.cut).alias("above"))
    k = keyed.agg(F.count(F.when(F.col("above"), 1))).first()[0]
    if not k:
        return Sample(model, float("inf"), seed), weighed
    last = global_rank(keyed.select("key"), [F.col("key").desc()], "place").where(F.col("place") == k).first()["key"]
    return Sample(model, last, seed), weighed


def filter_rows(docs: DataFrame, sample: Sample, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the sample holds, weighed again on the way, so no text is shuffled."""
    weight, key = fresh(docs.columns, "_weight"), fresh(docs.columns, "_key")
    rows = weigh(docs, sample.model, id_col, text, weight).withColumn(key, F.col(id_col).cast("long"))
    return rows.where(sample.keep(F.col(weight), key)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample, weighed = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return weighed.select(
        F.col("id").alias("doc_id"), (F.col("_weight") / UNIT).alias("log_weight"),
        sample.keep(F.col("_weight"), "id").alias("kept"))
