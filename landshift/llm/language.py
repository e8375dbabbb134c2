"""Language proportions of a text by expectation-maximisation over word likelihoods (operator 5).

A language is a smoothed distribution of hashed byte n-grams of words, counted over all learning
documents. A text is a mixture: each word comes from one language, and EM estimates the proportions.
Languages enter in the order of their proportions as long as the likelihood pays the penalty of one
more parameter; the largest proportion of the chosen set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, ragged, segment_sums, slices, text_bytes
from landshift.llm.pieces import distinct, words

BUCKETS, ORDERS, SMOOTH = 1 << 14, (1, 2, 3), 0.5
STEPS, UNDETERMINED = 6, "und"


@dataclass
class Model:
    """Languages in code-point order, and the log probability of every n-gram bucket in each."""

    languages: list[str]
    logp: np.ndarray


def grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words between word marks, on end, and how many each word has."""
    size = lengths + 2
    ends = np.cumsum(size)
    marked = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint64)
    marked[ragged(ends - size + 1, lengths)] = data[ragged(starts, lengths)]
    room = np.repeat(ends, size) - np.arange(len(marked))  # bytes left in the word
    rows = np.repeat(np.arange(len(size)), size)
    found, owner = [], []
    h = np.zeros(len(marked), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h[:len(h) - n + 1] = h[:len(h) - n + 1] * np.uint64(0x100000001B3) + marked[n - 1:] + np.uint64(1)
        if n in ORDERS:
            ok = room >= n
            mixed = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(50)).astype(np.int32))
            owner.append(rows[ok])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[order], sum(np.maximum(size - n + 1, 0) for n in ORDERS)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a text and a language; only sums by (language, bucket) leave the tasks."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            data, ends = text_bytes(part.column("text"))
            starts, lengths, counts = words(data, ends)
            if not len(starts):
                continue
            coded = part.column("lang").dictionary_encode()
            names = coded.dictionary.to_pylist()
            of_text = coded.indices.to_numpy()
            of_word = np.repeat(of_text, np.diff(np.append(0, counts)))
            first, inverse = distinct(data, starts, lengths)
            uses = np.bincount(inverse * len(names) + of_word, minlength=len(first) * len(names)).reshape(-1, len(names))
            buckets, n = grams(data, starts[first], lengths[first])
            for i, name in enumerate(names):
                found = np.bincount(buckets, np.repeat(uses[:, i], n), minlength=BUCKETS)
                total[name] = total.get(name, 0) + found.astype(np.int64)
        for name, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())],
                ["lang", "bucket", "n"])

    found = map_batches(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()), key=lambda x: x.encode())
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTH)
    at = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("bucket").to_numpy(), at] += found.column("n").to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _em(like: np.ndarray, text: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int) -> np.ndarray:
    """Proportions after some steps; ``like``: word by language, ``text``: the word's text."""
    ends = np.cumsum(counts)
    for _ in range(steps):
        part = like * share[text]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = (segment_sums(part.astype(np.float64), ends) / np.maximum(counts, 1)[:, None]).astype(np.float32)
    return share


def proportions(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) from word log likelihoods; languages outside the chosen set have 0.

    ``counts``: words of each text; a text without words has zeros only.
    """
    n, size = len(counts), logs.shape[1]
    out = np.zeros((n, size), np.float32)
    text = np.repeat(np.arange(n), counts)
    like = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
    share = _em(like, text, counts, np.full((n, size), 1 / size, np.float32), STEPS)
    single = segment_sums(logs.astype(np.float64), np.cumsum(counts))
    best = single.argmax(axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    # the set of one is the best single language; it leads the order
    order = np.take_along_axis(order, np.argsort(order != best[:, None], axis=1, kind="stable"), axis=1)
    out[np.arange(n), best] = counts > 0
    top = logs.max(axis=1) if len(logs) else np.zeros(0, np.float32)
    base = segment_sums(top.astype(np.float64), np.cumsum(counts))
    score = single.max(axis=1) - base
    live = np.flatnonzero(counts > 1)
    for k in range(2, size + 1):
        if not len(live):
            break
        rows = np.flatnonzero(np.isin(text, live)) if len(live) < n else np.arange(len(text))
        place = np.zeros(n, np.int64)
        place[live] = np.arange(len(live))
        inside = np.zeros((len(live), size), np.float32)
        np.put_along_axis(inside, order[live, :k], 1 / k, axis=1)
        part, of = like[rows], place[text[rows]]
        found = _em(part, of, counts[live], inside, STEPS)
        total = segment_sums(np.log(np.maximum((part * found[of]).sum(axis=1), 1e-30)).astype(np.float64), np.cumsum(counts[live]))
        better = total - 0.5 * (k - 1) * np.log(counts[live]) > score[live] - 0.5 * (k - 2) * np.log(counts[live])
        live = live[better]
        out[live], score[live] = found[better], total[better]
    return out


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, lang_pred, score (its proportion), languages (name to proportion).

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages.
    Equal proportions go to the first language by code point. ``keep``: columns that pass through; a new column that
    is called like one of them gets another name. Rows are independent, repeated rows and null ids stay; an empty
    table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [id_col, *keep]
    added = [fresh(columns, c) for c in ("lang_pred", "score", "languages")]
    schema = ", ".join(f"`{c}` {k}" for c, k in [*((c, kinds[c]) for c in columns), *zip(added, ("string", "double", "map<string,double>"))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        size, names = len(m.languages), np.array([*m.languages, UNDETERMINED], object)
        for part in slices(batches, text):
            data, ends = text_bytes(part.column(text))
            starts, lengths, upto = words(data, ends)
            counts = np.diff(np.append(0, upto))
            share = np.zeros((part.num_rows, max(size, 1)), np.float32)
            if size and len(starts):
                first, inverse = distinct(data, starts, lengths)
                buckets, n = grams(data, starts[first], lengths[first])
                # overlapping n-grams tell the same thing more than once
                logs = np.add.reduceat(m.logp[buckets], np.cumsum(n) - n, axis=0) / len(ORDERS)
                share = proportions(logs[inverse], counts)
            letters = np.zeros(256, bool)
            letters[[*range(65, 91), *range(97, 123)]] = True
            found = np.append(0, np.cumsum(letters[data]))[ends]
            known = np.diff(found) > 0
            for i in np.flatnonzero(~known & (counts > 0)).tolist():
                known[i] = any(map(str.isalpha, part.column(text)[i].as_py()))
            best = np.where(known & (size > 0), share.argmax(axis=1), size)
            score = np.where(best < size, share.max(axis=1), 0.0).astype(np.float64)
            held = np.argwhere((share > 0) & (best < size)[:, None])
            at = np.searchsorted(held[:, 0], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                *[part.column(c) for c in columns], pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0)),
                pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(names[held[:, 1]], pa.string()),
                                        pa.array(share[held[:, 0], held[:, 1]].astype(np.float64))),
            ], [*columns, *added])

    return map_batches(docs.select(*dict.fromkeys([*columns, text])), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids; a null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
