"""Quality rules on words, lines and tokeniser fertility (operator 7).

Two public vocabularies measure every text: byte-level merges give characters per token and the
entropy of the tokens, a piece vocabulary with byte fallback gives the share of byte tokens. The
bands of a group (a language) are quartiles of its distinct texts widened by their distance, so they
follow the corpus; a document outside a band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.llm.arrow import SLICE_BYTES, map_batches, ragged, segment_sums, slices, text_bytes
from landshift.llm.bpe import vocabulary
from landshift.llm.pieces import PieceMemory, distinct, windows, words
from landshift.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Distance of a band's ends from its quartiles, in distances of the quartiles. Of the labelled documents of sf0.1 that
#: pass the base rules, a width of 2 keeps 3322 of 3330 good and 135 of 301 poor ones, 3 keeps 3330 and 197.
WIDTH, LENGTH = 2.0, 120
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double"


@cache
def _fallback(model: str) -> tuple[PieceMemory, np.ndarray]:
    """Memory of word pieces, and which ids stand for single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = sp.encode([p.decode("utf-8", "replace") for p in pieces], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())), counts

    return PieceMemory(encode, 300_000), is_byte


@cache
def _blank_words(path: str) -> PieceMemory:
    """Memory of words after a blank, as merges see them inside a text."""
    v = vocabulary(path)
    return PieceMemory(lambda found: v.encode([b" " + x for x in found]), 300_000)


def _lines(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that are equal to an earlier line. ``starts``: of all words."""
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([ends[:-1], breaks + 1]))
    n = len(begin)
    stop = np.append(begin[1:], len(data))
    of = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(breaks, ends)) + 1)
    after = np.append(begin[1:], len(data))
    closed = (after > begin) & (stop > 0)
    closed[closed] = data[stop[closed] - 1] == 0x0A
    closed &= np.append(of[1:] == of[:-1], False)
    length = stop - begin - closed
    has_word = np.searchsorted(starts, begin + length) > np.searchsorted(starts, begin)
    rows = np.flatnonzero(has_word)
    if not len(rows):
        return np.zeros(len(ends) - 1, np.int64)
    _, same = distinct(data, begin[rows], length[rows])
    first = np.unique(of[rows] * n + same, return_index=True)[1]
    again = np.ones(len(rows), bool)
    again[first] = False
    return np.bincount(of[rows][again], minlength=len(ends) - 1)


def _repeats(ids: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Per text: words inside windows that the text holds twice or more."""
    at, same = windows(ids, upto, REPEAT_WINDOW)
    inside = np.zeros(len(ids) + 1, np.int64)
    twice = at[np.bincount(same, minlength=1)[same] > 1] if len(at) else at
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + REPEAT_WINDOW, -1)
    return segment_sums((np.cumsum(inside[:-1]) > 0).astype(np.int64), upto)


def _entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits per token of each text's own token distribution, over the most that its length allows."""
    text = np.repeat(np.arange(len(counts)), counts)
    key, n = np.unique(text << 32 | ids.astype(np.int64), return_counts=True)
    of = key >> 32
    p = n / counts[of]
    bits = np.bincount(of, -p * np.log2(p), minlength=len(counts))
    return np.where(counts > 1, bits / np.log2(np.maximum(counts, 2)), 1.0)


def measure(
    docs: DataFrame, merges: str, pieces: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, kept columns and the measures. A text without words has zeros and null ratios."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [id_col, *keep]
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, (fallback, is_byte) = _blank_words(merges), _fallback(pieces)
        for part in slices(batches, text, 4 * SLICE_BYTES):  # more repeats to a slice, fewer look-ups
            data, ends = text_bytes(part.column(text))
            starts, lengths, upto = words(data, ends)
            n = np.diff(np.append(0, upto))
            first, same = distinct(data, starts, lengths)
            letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            chars = segment_sums(letters[starts + lengths] - letters[starts], upto)
            slot = plain.lookup(data, starts[first], lengths[first])[same]
            sizes = plain.length[slot]
            ids, tokens = plain.ids[ragged(plain.start[slot], sizes)], segment_sums(sizes, upto)
            at = fallback.lookup(data, starts[first], lengths[first])
            of_piece = np.repeat(np.arange(len(at)), fallback.length[at])
            raw = is_byte[fallback.ids[ragged(fallback.start[at], fallback.length[at])]]
            n_bytes = np.bincount(of_piece, raw, minlength=len(at))[same]
            n_pieces = segment_sums(fallback.length[at][same], upto)
            some = n > 0
            yield pa.RecordBatch.from_arrays([
                *[part.column(c) for c in columns], pa.array(n), pa.array(chars),
                pa.array(segment_sums(symbol[data], ends[1:])), pa.array(_lines(data, ends, starts)),
                pa.array(_repeats(same, upto)),
                pa.array(chars / np.maximum(tokens, 1), mask=~some),
                pa.array(segment_sums(n_bytes, upto) / np.maximum(n_pieces, 1), mask=~some),
                pa.array(_entropy(ids, tokens), mask=~some),
            ], [*columns, *[x.split()[0] for x in MEASURES.split(", ")]])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], MEASURES])
    return map_batches(docs.select(*dict.fromkeys([*columns, text])), run, schema)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame, group: str) -> DataFrame:
    """Per group and measure: outer quartiles and their distance, over the texts that pass the base rules.

    Rows of one group with equal measures count once, so copies of a text don't move the band. The distance
    counts as a fiftieth of the median at least.
    """
    def quartiles(c: str) -> list:
        q = F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000)
        return [q[0].alias(f"low_{c}"), q[2].alias(f"high_{c}"), F.greatest(q[2] - q[0], q[1] / 50, F.lit(0.002)).alias(f"gap_{c}")]

    texts = measured.where(~_base_failed()).select(F.col(group).alias("_group"), *[x.split()[0] for x in MEASURES.split(", ")]).distinct()
    return texts.groupBy("_group").agg(
        *quartiles("chars_per_token"), *quartiles("byte_share"), *quartiles("token_entropy"))


def judge(measured: DataFrame, group: str, width: float = WIDTH) -> DataFrame:
    """Adds base_failed and kept. A null group is a group of its own; an empty text fails the base rules.

    A band reaches ``width`` distances below the lower quartile and twice as many above the upper one, as
    plain text has longer tokens where the vocabulary happens to know its words. For fewer than ``LENGTH`` words it is wider
    by the root of the ratio, as the spread of a mean over so few words is.
    """
    base = _base_failed()
    reach = F.lit(width) * F.greatest(F.lit(1.0), F.sqrt(F.lit(float(LENGTH)) / F.greatest(F.col("n_words"), F.lit(1))))

    def low(c: str):
        return F.col(c) >= F.col(f"low_{c}") - reach * F.col(f"gap_{c}")

    def high(c: str):
        return F.col(c) <= F.col(f"high_{c}") + 2 * reach * F.col(f"gap_{c}")

    inside = low("chars_per_token") & high("chars_per_token") & high("byte_share") & low("token_entropy")
    judged = measured.join(bands(measured, group), F.col(group).eqNullSafe(F.col("_group")), "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in measured.columns], base.alias("base_failed"),
        (~base & F.coalesce(inside, F.lit(True))).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    measured = cut_lineage(measure(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), keep=("lang",)))
    return judge(measured, "lang").drop("lang")
