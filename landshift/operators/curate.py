"""Geographic splits without leakage, duplicates, sample contracts, reports, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import codes, sha256
from landshift.operators.components import connected_components
from landshift.operators.nearby import box_links
from landshift.session import cut_lineage


def proximity_links(items: DataFrame, distance: float = 0.0) -> DataFrame:
    """Links of items that share a region or lie within a distance.

    A region is a star on its least item, near items come as sparse links; neither lists pairs.
    """
    hubs = items.groupBy("region_group").agg(F.min("id").alias("src"))
    regions = items.join(hubs, "region_group").where(F.col("id") != F.col("src")).select("src", F.col("id").alias("dst"))
    return regions.unionByName(box_links(items.select("id", "box"), distance))


def split_of(group_id: Column, seed: int = K.SPLIT_SEED, train: float = K.TRAIN_RATIO,
             validation: float = K.VALIDATION_RATIO) -> Column:
    """Split by the first eight bytes of a seeded hash, as a fraction of 2**64."""
    head = F.substring(sha256(F.concat(F.lit(f"{seed}:"), group_id)), 1, 16)
    value = F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)
    return F.when(value < train, "train").when(value < train + validation, "validation").otherwise("test")


def geographic_splits(items: DataFrame, distance: float = 0.0, **cfg) -> DataFrame:
    """Items (id, region_group, box) with their group and its split; groups never straddle splits."""
    links = cut_lineage(proximity_links(items, distance))
    groups = connected_components(links, items.select(F.col("id").alias("vertex")))
    return items.join(groups.withColumnsRenamed({"vertex": "id", "component": "group_id"}), "id").withColumn(
        "split", split_of(F.col("group_id"), **cfg))


def split_leakage(items: DataFrame, distance: float = 0.0) -> DataFrame:
    """Groups whose items sit in different splits, and items without a split.

    Every leaking pair lies inside one proximity group, so a group with two splits leaks
    and one without does not: the sparse links answer it without listing pairs.
    """
    links = cut_lineage(proximity_links(items, distance))
    groups = connected_components(links, items.select(F.col("id").alias("vertex")))
    joined = items.join(groups.withColumnsRenamed({"vertex": "id", "component": "group_id"}), "id")
    return joined.groupBy("group_id").agg(
        F.count("*").alias("items"), F.count_distinct("split").alias("splits"),
        F.count_if(F.col("split").isNull() | (F.col("split") == "unassigned")).alias("unassigned"),
    ).where((F.col("splits") > 1) | (F.col("unassigned") > 0)).withColumn(
        "error_code", F.when(F.col("unassigned") > 0, "UNASSIGNED_SPLIT").otherwise("SPLIT_LEAKAGE"))


def cross_split_duplicates(items: DataFrame, content: str) -> DataFrame:
    """Equal content in more than one split; counts per split combine before the shuffle."""
    per = items.groupBy(content, "split").agg(F.count("*").alias("_n"))
    return per.groupBy(content).agg(F.sum("_n").alias("items"), F.count("*").alias("splits")).where("splits > 1")


def sample_violations(
    pixels: DataFrame, meta: DataFrame, key: str = "pair_id", labels: int = 5, bands: list[str] | None = None,
) -> DataFrame:
    """Contract codes of every sample: size, class range, binary masks, content hash, label state, registration.

    ``meta``: key, width, height, label_quality, transform_plausible, overlap_ratio and, where ``bands`` are given,
    pair_sha256, which must be the hash of these bands; a missing hash is a mismatch.
    """
    seen = pixels.groupBy(key).agg(
        F.count("*").alias("_n"), F.max("row").alias("_r"), F.max("col").alias("_c"),
        F.min("target").alias("_t0"), F.max("target").alias("_t1"),
        F.max(F.when(~F.col("old_mask").isin(0, 1) | ~F.col("new_mask").isin(0, 1), 1).otherwise(0)).alias("_m"))
    if bands is None:
        meta = meta.withColumn("_other", F.lit(False))
    else:
        counted = pair_hash(pixels, bands, key).withColumnRenamed("pair_sha256", "_counted")
        meta = meta.join(counted, key, "left").withColumn("_other", ~F.col("pair_sha256").eqNullSafe(F.col("_counted"))).drop("_counted")
    c = F.col
    found = codes(
        (c("_n").isNull() | (c("_n") != c("width") * c("height")) | (c("_r") != c("height") - 1)
         | (c("_c") != c("width") - 1), "DIMENSIONS"),
        ((c("_t0") < 0) | (c("_t1") > labels), "UNSUPPORTED_LABELS"),
        (c("_m") > 0, "MASK_NOT_BINARY"),
        (c("_other"), "PAIR_HASH_MISMATCH"),
        (c("label_quality") == "rejected", "LABEL_REJECTED"),
        (~c("transform_plausible") | (c("overlap_ratio") <= 0), "REGISTRATION_INVALID"),
    )
    out = meta.join(seen, key, "left").withColumn("violations", found).withColumn("first_code", F.get("violations", F.lit(0)))
    return out.drop("_n", "_r", "_c", "_t0", "_t1", "_m", "_other")


def dataset_report(pixels: DataFrame, meta: DataFrame, key: str = "pair_id") -> DataFrame:
    """Counts as (kind, name, n, ratio): samples per split, pixels per class, empty samples, labelled pixels.

    The ratio of the labelled pixels is the coverage; other rows, and a table without pixels, have none. Pixels are counted
    per sample and class once; the rest reads that short table.
    """
    none = F.lit(None).cast("double").alias("ratio")
    splits = meta.groupBy(F.col("split").alias("name")).agg(F.count("*").alias("n")).select(F.lit("split").alias("kind"), "name", "n", none)
    per = cut_lineage(pixels.groupBy(key, "target").agg(F.count("*").alias("n")))
    classes = per.groupBy(F.col("target").cast("string").alias("name")).agg(F.sum("n").alias("n")).select(
        F.lit("class").alias("kind"), "name", "n", none)
    empty = per.groupBy(key).agg(F.max("target").alias("_t")).agg(
        F.lit("empty").alias("kind"), F.lit("samples").alias("name"), F.count_if(F.col("_t") == 0).alias("n"), none)
    labelled = F.coalesce(F.sum(F.when(F.col("target") != 0, F.col("n"))), F.lit(0))
    coverage = per.agg(
        F.lit("coverage").alias("kind"), F.lit("labelled").alias("name"), labelled.alias("n"), (labelled / F.sum("n")).alias("ratio"))
    return splits.unionByName(classes).unionByName(empty).unionByName(coverage)


def raster_hashes(pixels: DataFrame, images: dict[str, list[str]], key: str) -> DataFrame:
    """Content hashes of the images of ``key`` over their ordered pixels, in two levels; ``images``: bands by name.

    Each row of pixels is hashed on its own, then the row hashes in order, so at most one image
    row (and one list of row hashes) is held at a time. The images of one key share their shuffles.
    """
    cells = [F.concat_ws(",", *[F.col(b).cast("string") for b in bands]).alias(name) for name, bands in images.items()]
    rows = pixels.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", *cells))).alias("_p")).select(
        key, "row", F.size("_p").alias("_w"),
        *[sha256(F.array_join(F.col(f"_p.{name}"), ";")).alias(name) for name in images])
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", *images))).alias("_r"), F.max("_w").alias("_width"))
    size = F.concat_ws("|", F.size("_r").cast("string"), F.col("_width").cast("string"))
    return whole.select(key, *[
        sha256(F.concat_ws("|", size, F.array_join(F.col(f"_r.{name}"), ""))).alias(name) for name in images])


def tile_hash(pixels: DataFrame, bands: list[str], key: str = "raster_id") -> DataFrame:
    """Content hash of every raster."""
    return raster_hashes(pixels, {"tile_sha256": bands}, key)


def pair_hash(pixels: DataFrame, bands: list[str], key: str = "pair_id") -> DataFrame:
    """Content hash of every pair: the hash of its old and its new image's hash. ``pixels``: key, row, col, old_ and new_ bands."""
    both = raster_hashes(pixels, {side: [f"{side}_{b}" for b in bands] for side in ("old", "new")}, key)
    return both.select(key, sha256(F.concat_ws("|", "old", "new")).alias("pair_sha256"))


def channel_stats(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Mean and population deviation of every band in 0..1; a flat band gets deviation 1."""
    unit = {b: F.col(b) / 255.0 for b in bands}

    def deviation(x: Column) -> Column:
        return F.when(F.stddev_pop(x) < 1e-6, 1.0).otherwise(F.stddev_pop(x))

    return pixels.agg(*[F.avg(x).alias(f"{b}_mean") for b, x in unit.items()],
                      *[deviation(x).alias(f"{b}_std") for b, x in unit.items()])
