"""Source divergence audit (operator 12).

Every (lang, source) group has a share of each of its language's terms. Groups of a language are compared
pairwise over all terms, and each group's own terms are ranked against the language. The best terms of a group are
found by a dominance skyband: a term stands behind every other with at least its count in the group, at most its
count in the language, and an earlier name, whatever the shares are. So a partition keeps the terms with fewer than
k such others among its own, the skybands are merged in two steps, and only what is left is ranked by exact values.

Comparing groups touches only terms that both have: what a term adds for counts of zero is known per group, and
terms of one group alone add up by their distinct counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landshift.llm.arrow import map_batches, ragged, slices, text_bytes
from landshift.llm.pieces import distinct, words
from landshift.session import cut_lineage

#: Documents of a language that a term needs, units of a share, and terms ranked per group.
LEAST_DOCS, UNITS, TOP = 3, 1_000_000_000, 200
#: Rows that a task holds before it combines them, bytes of a slice, rows of a skyband's block, parts of the first merge.
HELD, SLICE, BLOCK, PARTS = 200_000, 1 << 20, 1024, 32
#: Bytes of terms: letters and whatever is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def _combined(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _slice_counts(part: pa.RecordBatch) -> pa.Table:
    data, ends = text_bytes(part.column("text"))
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, lengths, upto = words(data, ends, LETTERS)
    first, term = distinct(data, starts, lengths)
    row = np.repeat(np.arange(len(upto)), np.diff(np.append(0, upto)))
    in_row, times = np.unique(row << 32 | term, return_counts=True)
    known: dict[tuple, int] = {}
    group = np.array([known.setdefault(g, len(known)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
    keys, at = np.unique(group[in_row >> 32] << 32 | in_row & 0xFFFFFFFF, return_inverse=True)
    names = np.append(0, np.cumsum(lengths[first])).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(names), pa.py_buffer(data[ragged(starts[first], lengths[first])])).cast(pa.string())
    langs, sources = (pa.array([g[i] for g in known], pa.string()).take(pa.array(keys >> 32)) for i in (0, 1))
    return pa.table({
        "lang": langs, "source": sources, "term": terms.take(pa.array(keys & 0xFFFFFFFF)),
        "n": np.bincount(at, times, len(keys)).astype(np.int64), "docs": np.bincount(at, minlength=len(keys))})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, combined per task; rows of one key are to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in slices(batches, "text", SLICE):
            held.append(_slice_counts(part))
            if sum(t.num_rows for t in held) > HELD:
                held = [_combined(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 14)
        if held:
            yield from _combined(held).to_batches(max_chunksize=1 << 14)

    kinds = "lang string, source string, term string, n long, docs long"
    return map_batches(docs.select("lang", "source", "text"), run, kinds)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least ``least`` documents of the language; ``lang_n``: count in
    the language; ``first``: whether the row is its term's first of the language."""
    whole = Window.partitionBy("lang", "term")
    per = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return per.select(
        "lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("_docs"),
        (F.col("source") == F.min("source").over(whole)).alias("first")).where(F.col("_docs") >= least).drop("_docs")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / (total + terms)) in decimals, so that no count is too large; null without terms."""
    above = F.lit(UNITS).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 1)
    below = F.when(terms > 0, total.cast("decimal(20,0)") + terms.cast("decimal(20,0)"))
    return 1 + F.call_function("div", above, below)


def _apart(p: str | Column, q: str | Column) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, held, lang_total, lang_terms, p0) of every group: occurrences and number of its kept terms, the
    same of its language, and its share of a term that it hasn't."""
    sums = terms.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"), F.count_if("first").alias("own"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("own").alias("lang_terms"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "lang_total", "lang_terms")]
    rows = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero)
    return rows.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("lang_terms")))


def _sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def group_pairs(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group and each other group of its language, summed over all kept terms.

    ``terms``: (lang, source, term, p); ``totals``: as of ``group_totals``.
    """
    has = terms.join(totals.select("lang", "source", "p0"), ["lang", "source"])
    left = has.select("lang", "term", "source", "p", "p0")
    right = has.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item").agg(
        _sum(_apart("p", "q") - _apart("p", "q0") - _apart("p0", "q") + _apart("p0", "q0")).alias("both"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")).join(other, "lang").where(
        "source <> item").groupBy("lang", "source", "item").agg(
        _sum(F.col("times") * _apart("p", "q0")).alias("ahead"), _sum(F.col("times") * _apart("q0", "p")).alias("behind"))
    alone = cut_lineage(alone)
    mirror = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "behind")
    right = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("item_held"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("both", "ahead", "behind")]
    pairs = totals.join(right, "lang").where("source <> item")
    for part in (both, alone.drop("behind"), mirror):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    rest = (F.col("lang_terms") - F.col("held") - F.col("item_held")) * F.coalesce(_apart("p0", "q0"), F.lit(0)).cast("decimal(20,0)")
    return pairs.select("*", rest.alias("rest")).select("lang", "source", "item", "rest", *zero).select(
        "lang", "source", "item", F.expr("both + ahead + behind + rest").cast("long").alias("value"))


class Band:
    """Members of one group's skyband; rows come with the larger count first, then the smaller language count, then by name,
    so whatever dominates a row came before it."""

    def __init__(self, k: int):
        self.k, self.less, self.terms = k, np.zeros(0, np.int64), pa.array([], pa.string())
        self.cell, self.in_cell = None, 0

    def add(self, more: np.ndarray, less: np.ndarray, terms: pa.Array) -> np.ndarray:
        """Indices of the given rows that fewer than k others dominate."""
        # rows of equal counts stand behind all the earlier ones of theirs
        new = np.append(True, (more[1:] != more[:-1]) | (less[1:] != less[:-1]))
        begin = np.flatnonzero(new)
        place = np.arange(len(more)) - np.repeat(begin, np.diff(np.append(begin, len(more))))
        if self.cell == (more[0], less[0]):
            place[:begin[1] if len(begin) > 1 else len(more)] += self.in_cell
        self.cell, self.in_cell = (more[-1], less[-1]), int(place[-1]) + 1
        out = []
        on = np.flatnonzero(place < self.k)
        for a in range(0, len(on), BLOCK):
            rows = on[a:a + BLOCK]
            names = pa.concat_arrays([self.terms, terms.take(pa.array(rows))])
            order = pc.rank(names, tiebreaker="min").to_numpy()
            m, own = len(self.less), less[rows]
            behind = ((self.less <= own[:, None]) & (order[:m] < order[m:, None])).sum(axis=1)
            behind += np.tril((own <= own[:, None]) & (order[m:] < order[m:, None]), -1).sum(axis=1)
            stay = behind < self.k
            self.less = np.append(self.less, own[stay])
            self.terms = names.take(pa.array(np.append(np.arange(m), m + np.flatnonzero(stay))))
            out.append(rows[stay])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def skyband(rows: DataFrame, k: int = TOP, also: tuple[str, ...] = ()) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, lang_n, more columns) those that fewer than ``k`` others of
    their group (and of equal columns ``also``) in the partition dominate. A task holds the members of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, Band(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", *also))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != group:
                    group, band = keys[a], Band(k)
                part = batch.slice(a, b - a)
                stay = band.add(part.column("n").to_numpy(), part.column("lang_n").to_numpy(), part.column("term"))
                if len(stay):
                    yield part.take(pa.array(stay))

    order = [*also, F.col("n").desc(), "lang_n", "term"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows.sortWithinPartitions("lang", "source", *order), run, kinds)


def top_terms(rows: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of each group's ``k`` terms of greatest value. ``rows``: (lang, source, term, n, lang_n, p, q)."""
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    split = skyband(rows, k).withColumn("part", part).repartition("lang", "source", "part")
    merged = skyband(skyband(split, k, ("part",)).drop("part").repartition("lang", "source"), k)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return merged.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value")).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each group with every other of its language, part
    ``term`` lists a group's ``k`` terms that stand out most against its language.

    Null texts, languages and sources are ''; other columns are not looked at. Every row is a document, repeated rows too. A group
    without terms has pairs; one that is alone in its language has none, and its terms don't stand out, as their shares are the
    language's. A language without kept terms has pairs of value 0. Equal values go by the item's bytes. An empty
    table gives no rows.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    terms = cut_lineage(kept_terms(term_counts(given), least))
    totals = cut_lineage(group_totals(given.select("lang", "source").distinct(), terms))
    shares = terms.join(totals, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", _share(F.col("n"), F.col("total"), F.col("lang_terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("lang_terms")).alias("q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = group_pairs(shares.select("lang", "source", "term", "p"), totals).withColumn("rank", F.row_number().over(ranked))
    best = top_terms(shares.where("p > q"), k)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(best.withColumn("part", F.lit("term")).select(*out))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p,
  1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(n) OVER l + count(*) OVER s) AS q
  FROM every WINDOW s AS (PARTITION BY lang, source), l AS (PARTITION BY lang)),
pairs AS (SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang)
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
