"""Loading by declared schema; publishing, manifests, exports and merges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from landshift.functions import boxes as G
from landshift.functions.scalars import canonical_json, sha256
from landshift.sources.schemas import ENTITIES, schema_of


HASH_BLOCK = 1 << 20


class SchemaMismatch(ValueError):
    """Stored columns differ from the declared ones."""


def _flat(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields}


def load_table(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One Parquet table; extra, missing or retyped columns are refused before any row is read."""
    declared = schema or schema_of(name)
    path = f"{root.rstrip('/')}/{name}.parquet"
    stored = spark.read.parquet(path).schema
    if _flat(stored) != _flat(declared):
        raise SchemaMismatch(f"{name}: stored {_flat(stored)} but declared {_flat(declared)}")
    return spark.read.schema(declared).parquet(path)


def load_tables(spark: SparkSession, root: str, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    chosen = schemas or {name: schema_of(name) for name in ENTITIES}
    return {name: load_table(spark, root, name, schema) for name, schema in chosen.items()}


def write_catalogue(tables: dict[str, DataFrame], quarantine: DataFrame, path: str) -> None:
    """Every table and the quarantine (also when empty) as zstd Parquet."""
    for name, df in {**tables, "quarantine": quarantine}.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}.parquet")


def manifest(tables: dict[str, DataFrame], quarantine: DataFrame) -> DataFrame:
    """Rows per table, rows per quarantine reason, and an order-free digest of each table.

    Parquet bytes differ between runs, so the digest sums row hashes instead of hashing files.
    """
    def digest(df: DataFrame) -> Column:
        return F.coalesce(
            F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).cast("string"), F.lit("0"))

    parts = [
        df.agg(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"),
               digest(df).alias("digest"))
        for name, df in sorted(tables.items())
    ]
    reasons = quarantine.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"), digest(quarantine).alias("digest"))
    parts.append(reasons.select(F.lit("quarantine").alias("kind"), F.col("reason_code").alias("name"), "n", "digest"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


SPATIAL = (
    ("municipality", "municipalities", "municipality_id"), ("ward", "wards", "ward_id"),
    ("parcel", "parcels", "parcel_id"), ("approved_footprint", "approved_footprints", "footprint_id"),
    ("public_boundary", "public_boundaries", "boundary_id"),
)


def geojson_features(tables: dict[str, DataFrame]) -> DataFrame:
    """One GeoJSON Feature text per spatial record."""
    out = None
    for kind, name, key in SPATIAL:
        if name not in tables:
            continue
        part = tables[name].select(
            F.lit(kind).alias("record_type"), F.col(key).alias("id"),
            F.concat(
                F.lit('{"type":"Feature","id":'), F.to_json(F.struct(F.col(key).alias("v"))).substr(F.lit(6), F.length(key) + 2),
                F.lit(',"geometry":'), G.box_json(F.col("box")),
                F.lit(f',"properties":{{"record_type":"{kind}","crs":"'), F.col("crs"), F.lit('"}}'),
            ).alias("feature"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


def write_queue(queue: DataFrame, path: str) -> DataFrame:
    """Review queue as range-sorted JSON lines; returns its count and order-free checksum."""
    queue.repartitionByRange(F.desc("risk_score"), F.asc("case_id")).sortWithinPartitions(
        F.desc("risk_score"), F.asc("case_id")
    ).write.mode("overwrite").json(path)
    stored = queue.sparkSession.read.text(path)
    return stored.agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("checksum"))


def case_packages(cases: DataFrame, evidence: DataFrame, events: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Case export as canonical lines: one head per case, then evidence, then events.

    A package is the lines of one case in (part, position) order; a long case is many rows and
    is never gathered into one value.
    """
    def line(df: DataFrame, part: int, position: Column) -> DataFrame:
        fields = {c: F.col(c) for c in df.columns if c != "case_id"}
        return df.select(
            "case_id", F.lit(part).alias("part"), position.cast("long").alias("position"),
            canonical_json(fields).alias("body"))

    head = cases.withColumn("schema_version", F.lit(version))
    lines = line(head, 0, F.lit(0)).unionByName(line(evidence, 1, F.col("position"))).unionByName(
        line(events, 2, F.col("seq")))
    return lines.withColumn("line_sha256", sha256(F.col("body")))


def write_packages(packages: DataFrame, path: str) -> None:
    """Packages spread by (case, part, position) ranges so that one long case fills many files."""
    packages.repartitionByRange("case_id", "part", "position").sortWithinPartitions(
        "case_id", "part", "position"
    ).write.mode("overwrite").option("compression", "zstd").parquet(path)


def file_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """Content hash of every matching file; tasks read files in blocks, so their size doesn't matter. Spark lists no empty files."""
    listed = spark.read.format("binaryFile").load(glob).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                digest = hashlib.sha256()
                with fs.open_input_stream(name, compression=None) as stream:
                    while block := stream.read(HASH_BLOCK):
                        digest.update(block)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], [*batch.schema.names, "content_sha256"])

    return listed.mapInArrow(run, "path string, length long, content_sha256 string")


def merge_immutable(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """State of every id after an insert that may not change a stored payload.

    Adds ``state``: stored, new, same or conflict. Payloads are compared as canonical JSON.
    """
    def packed(df: DataFrame, alias: str) -> DataFrame:
        return df.select(key, canonical_json({c: F.col(c) for c in df.columns}).alias(alias))

    both = packed(stored, "_old").join(packed(incoming, "_new"), key, "full_outer")
    old, new = F.col("_old"), F.col("_new")
    return both.select(
        key,
        F.when(new.isNull(), "stored").when(old.isNull(), "new").when(old == new, "same").otherwise("conflict")
        .alias("state"),
        F.coalesce(old, new).alias("payload"),
    )


def merge_latest(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key; a grouped maximum, so hot keys combine before the shuffle."""
    rows = stored.unionByName(incoming)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r"))
    return latest.select("_r.*")


def bundle_state(results: DataFrame, cases: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Results and cases are published together: complete, or which half is missing."""
    r = results.select(key, F.lit(True).alias("_r"))
    c = cases.select(key, F.lit(True).alias("_c"))
    return r.join(c, key, "full_outer").select(
        key,
        F.when(F.col("_r").isNull(), "RESULT_MISSING").when(F.col("_c").isNull(), "CASE_MISSING")
        .otherwise("COMPLETE").alias("state"))
