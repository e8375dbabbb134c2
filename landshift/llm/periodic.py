"""Periodic runs of words (operator 11).

A run is a stretch of words with smallest period q that is at least ``LEAST`` words and ``FOLD`` periods
long and that no neighbouring word extends. They are found by a sparse dynamic programme over
diagonals: the cell (word, lag) is one more than the cell of the word before on the same lag when the
word has an earlier occurrence that many words back. A diagonal that ends with sufficient length is a run.

Frequent words would fill the whole triangle with cells. A lag d counts only where at least
(FOLD - 1) * d words match on end, so of the lags from 2 ** k to 2 ** (k + 1) - 1 only occurrences matter whose next
3 * 2 ** k words match too. Such a window's nearest earlier occurrence is enough: if it also occurs d words
back, its nearest lag divides d (Fine and Wilf), so that d is no smallest period there. A word thus has one cell a
scale at most, n log n in all, and windows get exact names by joining the names of their halves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.llm.arrow import fresh, map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import distinct, words

#: A run has this many words and this many periods at least; FOLD is bound to the windows' length of 3 * 2 ** k.
LEAST, FOLD = 6, 4
RUN = "struct<start:long,length:long,period:long>"

#: Maps (ids of the rows, words of each) to the number, within its text, of the word that stands at each place.
Rewrite = Callable[[list, np.ndarray], np.ndarray]


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for every pair of numbers below 2 ** 31; equal pairs have equal ones."""
    return np.unique(first << np.int64(32) | second, return_inverse=True)[1]


def _nearest(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lag to the nearest earlier position of the same name, 0 for none; ``at`` ascends."""
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    lag = np.zeros(len(at), np.int64)
    lag[order[1:]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
    return lag


def find_runs(ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start within the text, length, period) of all runs, by text, start and period.

    ``ids``: word numbers below 2 ** 31 of all texts on end; ``upto``: number of words up to each text's end.
    """
    empty = np.zeros(0, np.int64)
    counts = np.diff(np.append(0, upto))
    text = np.repeat(np.arange(len(upto)), counts)
    one = _names(text, ids.astype(np.int64)) if len(ids) else empty
    again = np.bincount(one, minlength=1)[one] > 1 if len(ids) else np.zeros(0, bool)
    # three words on end, all of them repeated in their text
    at = np.flatnonzero(again[:-2] & again[1:-1] & again[2:] & (text[:-2] == text[2:])) if len(ids) > 2 else empty
    name = _names(_names(one[at], one[at + 1]), one[at + 2]) if len(at) else empty
    found, width, scale = [], 3, 1
    while len(at):
        lag = _nearest(name, at)
        cell = np.flatnonzero((lag >= scale) & (lag < 2 * scale))
        found.append(_diagonals(at[cell], lag[cell], width))
        again = np.bincount(name)[name] > 1
        at, name = at[again], name[again]
        # windows of twice the words from two that stand side by side in one text
        other = np.searchsorted(at, at + width)
        ok = other < len(at)
        ok[ok] = (at[other[ok]] == at[ok] + width) & (text[at[other[ok]]] == text[at[ok]])
        name, at = (_names(name[ok], name[other[ok]]), at[ok]) if ok.any() else (empty, empty)
        width, scale = 2 * width, 2 * scale
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty)
    # of one stretch the least lag is its period, the others are multiples of it
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    of = text[start[order]]
    return of, start[order] - (upto - counts)[of], length[order], period[order]


def _diagonals(at: np.ndarray, lag: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the diagonals that end with sufficient length. Cells come by place; on one lag,
    cells of consecutive places are one diagonal."""
    order = np.argsort(lag, kind="stable")
    at, lag = at[order], lag[order]
    begin = np.flatnonzero(np.append(True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1))[:len(at)])
    cells = np.diff(np.append(begin, len(at)))
    period = lag[begin]
    length = period + cells + width - 1
    ok = (length >= LEAST) & (length >= FOLD * period)
    return (at[begin] - period)[ok], length[ok], period[ok]


def strongest(of: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Per text that has runs, the index of the run with the greatest exact length / period; the first of equals."""
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])[:len(of)])
    best = begin.copy()
    sizes = np.diff(np.append(begin, len(of)))
    for step in range(1, int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > step)
        i = begin[on] + step
        better = length[i] * period[best[on]] > length[best[on]] * period[i]
        best[on[better]] = i[better]
    return best


def _stay(of: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    total = int(upto[-1]) if len(upto) else 0
    change = np.zeros(total + 1, np.int64)
    base = np.append(0, upto)[of] + start
    np.add.at(change, base + period, 1)
    np.add.at(change, base + length, -1)
    return np.cumsum(change)[:-1] == 0


def _joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upto: np.ndarray) -> pa.Array:
    """The words of each text with one blank between them."""
    room = lengths + 1
    begin = np.cumsum(room) - room
    out = np.full(int(room.sum()), 0x20, np.uint8)
    out[ragged(begin, lengths)] = data[ragged(starts, lengths)]
    ends = np.append(0, np.cumsum(room))[upto]
    if len(out):  # without the blank after the last word of each text
        keep = np.ones(len(out), bool)
        keep[ends[np.diff(np.append(0, upto)) > 0] - 1] = False
        out = out[keep]
        ends = np.append(0, np.cumsum(keep))[ends]
    return pa.LargeStringArray.from_buffers(len(upto), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "_periodic", rewrite: Rewrite | None = None,
) -> DataFrame:
    """The rows with a column ``name``: n_words, runs (by start, then period), strongest (greatest length / period, ties to
    the smaller start, then period; null without runs) and collapsed, the text whose runs are cut to their first period.

    Words are ``[^\\x20\\x09-\\x0D]+``; collapsed has one blank between words. A null, empty or blank text has no words, no
    runs and collapses to an empty text. Rows are independent, so repeated rows have equal results, null ids keep
    their rows, and an empty table gives no rows. A column that is called like ``name`` stays, the new one gets another name.
    ``rewrite`` replaces the words of a text by others of its own before runs are looked for.
    """
    name = fresh(docs.columns, name)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            data, ends = text_bytes(part.column(text))
            starts, lengths, upto = words(data, ends)
            if rewrite is not None and len(starts):
                counts = np.diff(np.append(0, upto))
                source = np.repeat(upto - counts, counts) + rewrite(part.column(id_col).to_pylist(), counts)
                starts, lengths = starts[source], lengths[source]
            of, start, length, period = find_runs(distinct(data, starts, lengths)[1], upto)
            best = strongest(of, length, period)
            stay = _stay(of, start, length, period, upto)
            left = np.append(0, np.cumsum(stay))[upto]
            runs = _struct(start, length, period)
            at = np.append(0, np.cumsum(np.bincount(of, minlength=len(upto)))).astype(np.int32)
            chosen = np.full(len(upto), -1, np.int64)
            chosen[of[best]] = best
            top = runs.take(pa.array(np.maximum(chosen, 0), mask=chosen < 0)) if len(runs) else pa.nulls(len(upto), runs.type)
            out = pa.StructArray.from_arrays(
                [pa.array(np.diff(np.append(0, upto))), pa.ListArray.from_arrays(pa.array(at), runs), top,
                 _joined(data, starts[stay], lengths[stay], left)], ["n_words", "runs", "strongest", "collapsed"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), out], [*columns, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{kinds}, `{name}` struct<n_words:long,runs:array<{RUN}>,strongest:{RUN},collapsed:string>")


def _struct(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])


def planted(ids: list, counts: np.ndarray) -> np.ndarray:
    """Every tenth document by crc32 of its id repeats a stretch of its words to its end; null ids repeat none."""
    h = np.array([1 if i is None else zlib.crc32(b"%d" % i) for i in ids], np.int64)
    n = counts.astype(np.int64)
    g = h // 10
    on = (h % 10 == 0) & (n > 0)
    a = np.where(on, g % np.maximum(n, 1), n)
    p = np.where(on, 1 + (n - a) // (3 + g % 8), 1)
    i = ragged(np.zeros(len(n), np.int64), n)
    a, p = np.repeat(a, n), np.repeat(p, n)
    return np.where(i >= a, a + (i - a) % p, i)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse(docs, rewrite=planted, name="found").select("doc_id", "found.*")
    line = "concat_ws(',', r.start, r.length, r.period)"
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.expr(f"concat_ws('', transform(runs, r -> concat({line}, '\\n')))"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
