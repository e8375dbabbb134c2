"""Mixing sources to target weights by capped water-filling (operator 3), in DataFrame functions only.

Sources are clamped at ``cap`` times their size; what they can't take is dealt out again by weight until
no source is above. A source's repetitions are split into whole ones, which every document gets, and
a rest, which goes to documents in a seeded order until it is used up. That order is never sorted as
a whole: sums over prefixes of the seeded key narrow it down to the one key where the rest ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landshift.llm.arrow import fresh
from landshift.operators.ranking import global_rank
from landshift.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that each narrowing step looks at; the last is the whole key.
PREFIXES = (3, 6, 32)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight); only sums come to the driver.

    A source is clamped where its weight times the level passes its cap. Clamping lifts the level for
    the rest, so the clamped set only grows, and the loop ends when it stays as it is.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, limit)).alias("c"),
            F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if row["n"] == clamped or not row["w"]:
            break
        level, clamped = (share * total - (row["c"] or 0.0)) / row["w"], row["n"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source: size, target, whole repetitions, and where the rest of a repetition ends.

    ``sized``: source, size, key. ``last_key``: documents with a smaller key get one repetition more;
    those with this very key share ``last_words`` in proportion to their sizes (``last_sum`` in all).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = global_rank(sums, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = cut_lineage(place.select("source", "source_size", weight.alias("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = cut_lineage(
        water_fill(sources, share, cap).withColumn("whole", whole)
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
        .withColumn("last_key", F.lit("")).withColumn("last_sum", F.lit(0).cast("long")))
    inside = sized
    for width in PREFIXES:
        at = out.select(F.col("source").alias("_s"), "last_key")
        inside = inside.join(at, F.col("source").eqNullSafe(F.col("_s")) & F.col("key").startswith(F.col("last_key"))).drop("_s", "last_key")
        part = inside.groupBy("source", F.substring("key", 1, width).alias("prefix")).agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(
            Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = part.withColumn("before", before).withColumnRenamed("source", "_s")
        found = (
            part.join(out.select("source", "rest"), F.col("source").eqNullSafe(F.col("_s")))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
            .select("_s", "prefix", (F.col("rest") - F.col("before")).alias("left"), "n"))
        out = cut_lineage(
            out.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("last_key", F.coalesce("prefix", "last_key"))
            .withColumn("rest", F.coalesce("left", "rest")).withColumn("last_sum", F.coalesce("n", "last_sum"))
            .drop("_s", "prefix", "left", "n"))
    return out.withColumnRenamed("rest", "last_words")


def size_rows(docs: DataFrame, seed: int, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(source).alias("source"), n_words(F.col(text)).alias("size"), seeded_key(id_col, seed).alias("key"))


def deal(rows: DataFrame, plans: DataFrame, source: Column, size: Column, key: Column, name: str) -> DataFrame:
    """Adds a struct ``name``: size, source_size, target, copies (whole repetitions), extra (words of one more), taken."""
    source_name, plan_name = fresh(rows.columns, "_mix_source"), fresh(rows.columns, "_mix_plan")
    known = plans.select(F.col("source").alias(source_name), F.struct(
        "source_size", "target", "whole", "last_key", "last_words", "last_sum").alias(plan_name))
    p = F.col(plan_name)
    later = key > p.last_key
    extra = (
        F.when(later, F.lit(0)).when(key < p.last_key, size)
        .otherwise(F.floor(p.last_words * size / F.greatest(p.last_sum, F.lit(1)))).cast("long"))
    copies = (p.whole + F.when(key < p.last_key, 1).otherwise(0)).cast("int")
    return (
        rows.join(known, source.eqNullSafe(F.col(source_name)))
        .withColumn(name, F.struct(
            size.alias("size"), p.source_size.alias("source_size"), p.target.alias("target"), copies.alias("copies"),
            F.when(key == p.last_key, extra).otherwise(0).cast("long").alias("extra"),
            (p.whole * size + extra).cast("long").alias("taken")))
        .drop(source_name, plan_name))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text: str = "text", source: str = "source", name: str = "_mix",
) -> DataFrame:
    """Every document with a struct ``name`` that says how many words of it the mix takes.

    A null source is a source of its own, last in order; a null or wordless text has size 0; a source
    without words has target 0; an empty table gives no rows. Rows of one id and source meet the end
    of a repetition together and share its words in proportion to their sizes. A column that is called like ``name`` stays,
    the new one gets another name.
    """
    name = fresh(docs.columns, name)
    plans = plan(cut_lineage(size_rows(docs, seed, id_col, text, source)), weights, share, cap)
    return deal(docs, plans, F.col(source), n_words(F.col(text)), seeded_key(id_col, seed), name)


def repeated(mixed: DataFrame, text: str = "text", name: str = "_mix") -> DataFrame:
    """The mix itself: a row for every whole repetition and one with the first words of a partial one."""
    m = F.col(name)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), F.lit(1), m.extra.cast("int")), "")
    parts = F.concat(
        F.array_repeat(F.struct(F.col(text).alias("t")), m.copies),
        F.when(m.extra > 0, F.array(F.struct(first.alias("t")))).otherwise(F.array().cast("array<struct<t:string>>")))
    columns = [c for c in mixed.columns if c != name]
    return mixed.withColumn(name, F.explode(parts)).select(
        *[F.col(f"{name}.t").alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = cut_lineage(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), seeded_key("doc_id", 17).alias("key")))
    plans = plan(rows.select("source", "size", "key"), (5, 2, 1), 1.5, 2.0)
    return deal(rows, plans, F.col("source"), F.col("size"), F.col("key"), "_mix").select(
        "doc_id", "size", "_mix.source_size", "_mix.target", "_mix.taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':17')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 1.5 * CAST(sum(n) OVER () AS DOUBLE) AS t, 2.0 * n / w AS r,
    CAST(coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS c,
    CAST(sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS free
  FROM s
), lv AS (
  SELECT min_by((t - c) / free, r) AS level FROM o WHERE r >= (t - c) / free
), p AS (
  SELECT source, n, least(2.0 * n, w * CAST(coalesce(level, 1e300) AS DOUBLE)) AS target FROM o LEFT JOIN lv ON true
), q AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM p
), g AS (
  SELECT source, k, sum(size) AS ks FROM d GROUP BY source, k
), h AS (
  SELECT source, k, ks, sum(ks) OVER (PARTITION BY source ORDER BY k) - ks AS before FROM g
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.n AS source_size, q.target,
  CAST(q.whole * d.size + CASE
    WHEN h.before + h.ks <= floor(q.target - q.whole * q.n) THEN d.size
    WHEN h.before >= floor(q.target - q.whole * q.n) THEN 0
    ELSE floor((floor(q.target - q.whole * q.n) - h.before) * d.size / h.ks) END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN h ON h.source IS NOT DISTINCT FROM d.source AND h.k = d.k
"""
