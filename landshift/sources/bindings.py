"""Domain tables as pure projections of the driver's Parquet tables.

Each function returns a lazy DataFrame; scans stay prunable because only projections and
equi-joins on keys are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.functions import boxes as G
from landshift.functions.constants import RISK_THRESHOLDS, RISK_WEIGHTS

CRS = "EPSG:32643"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def _id(prefix: str, *keys: Column) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[k.cast("string") for k in keys])


def lattice_x(k: Column) -> Column:
    return (k % 64 * 100).cast("double")


def lattice_y(k: Column) -> Column:
    return (F.floor(k / 64) * 100).cast("double")


def parcel_box(k: Column) -> Column:
    """90 m square on a 100 m lattice; every seventh one reaches into its neighbour."""
    x, y = lattice_x(k) + 5, lattice_y(k) + 5
    return G.box(x, y, x + 90 + F.when(k % 7 == 0, 20.0).otherwise(0.0), y + 90)


def footprint_box(k: Column) -> Column:
    """Approved outline inside the parcel; every eleventh one breaks the setback."""
    x = lattice_x(k) + 5 + F.when(k % 11 == 0, 1.0).otherwise(10.0 + k % 5)
    y = lattice_y(k) + 15 + k % 3
    return G.box(x, y, x + 30 + k % 4 * 5, y + 30 + k % 3 * 10)


def parcels(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = table(spark, root, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, root, "customer").select("c_custkey", "c_nationkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("ordinal"),
            _id("parcel", k).alias("parcel_id"),
            _id("ward", F.col("c_nationkey")).alias("ward_id"),
            _id("mun", F.col("n_regionkey")).alias("municipality_id"),
            F.concat(F.lit("zone-"), F.when(k % 2 == 0, "a").otherwise("b")).alias("zone"),
            F.lit(5.0).alias("setback_m"),
            parcel_box(k).alias("box"),
            F.lit(CRS).alias("crs"),
        )
    )


def approved_footprints(spark: SparkSession, root: str) -> DataFrame:
    """One per parcel, and a second later plan for every tenth parcel."""
    k = F.col("c_custkey")
    first = table(spark, root, "customer").select(
        (k * 2).alias("ordinal"),
        _id("fp", k).alias("footprint_id"),
        _id("bld", k).alias("building_id"),
        _id("parcel", k).alias("parcel_id"),
        (1 + k % 2).cast("int").alias("plan_version"),
        footprint_box(k).alias("box"),
        F.lit(CRS).alias("crs"),
    )
    b = F.col("box")
    second = first.where(F.col("ordinal") % 20 == 0).select(
        (F.col("ordinal") + 1).alias("ordinal"),
        F.concat(F.lit("late-"), F.col("footprint_id")).alias("footprint_id"),
        F.concat(F.lit("late-"), F.col("building_id")).alias("building_id"),
        "parcel_id",
        (F.col("plan_version") + 1).alias("plan_version"),
        G.box(b["min_x"], b["min_y"], b["max_x"] + 5, b["max_y"] + 5).alias("box"),
        "crs",
    )
    return first.unionByName(second)


def permits(spark: SparkSession, root: str) -> DataFrame:
    """Permits of parcels whose key is a multiple of fifty name a parcel that is gone, so those have none."""
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return (
        table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .select(
            _id("permit", k).alias("permit_id"),
            F.when(F.col("o_custkey") % 50 == 0, _id("parcel-gone", F.col("o_custkey")))
            .otherwise(_id("parcel", F.col("o_custkey"))).alias("parcel_id"),
            _id("fp", F.col("o_custkey")).alias("footprint_id"),
            (1 + k % 2).cast("int").alias("plan_version"),
            start.alias("valid_from"),
            F.date_add(start, (30 + k % 11 * 30).cast("int")).alias("valid_until"),
        )
    )


def changes(spark: SparkSession, root: str) -> DataFrame:
    """One detected change per line item, near the parcel of its order."""
    li = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount",
        "l_tax", "l_shipdate",
    )
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("o_custkey")
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    x = lattice_x(k) + p % 100
    y = lattice_y(k) + s % 80
    fp = footprint_box(k)
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _id("chg", F.col("l_orderkey"), line, p, s, F.date_format("l_shipdate", "yyyyMMdd"))
        .alias("change_id"),
        _id("parcel", k).alias("parcel_id"),
        F.to_date("l_shipdate").alias("capture_date"),
        F.col("l_shipdate").alias("capture_time"),
        (1 + p % 2).cast("int").alias("plan_version"),
        G.box(x, y, x + 5 + qty, y + 5 + p % 20).alias("box"),
        G.box(fp["min_x"], fp["min_y"], fp["max_x"] - 5, fp["max_y"]).alias("old_box"),
        G.box(fp["min_x"], fp["min_y"] + p % 3, fp["max_x"] + line * 2 - 6, fp["max_y"] + s % 5 - 2)
        .alias("new_box"),
        F.round(F.abs(F.col("l_discount")) * 10, 1).alias("change_confidence"),
        F.round(0.6 + F.abs(F.col("l_tax")) * 4, 2).alias("registration_quality"),
        F.slice(
            F.array(F.lit("EXTREME_DARKNESS"), F.lit("LOW_REGISTRATION_QUALITY"),
                    F.lit("VISUAL_REFINEMENT_SKIPPED"), F.lit("EXTREME_OVEREXPOSURE")),
            F.lit(1), (line % 5).cast("int"),
        ).alias("quality_warnings"),
        F.timestamp_add("DAY", (p % 400).cast("int"), F.col("l_shipdate")).alias("evaluation_time"),
        F.lit(CRS).alias("crs"),
    )


def rule_sets(spark: SparkSession, root: str) -> DataFrame:
    """Yearly rules per municipality and zone: one gap, one tie, an open end."""
    region = table(spark, root, "region").select("r_regionkey")
    r, y, z = F.col("r_regionkey"), F.col("y"), F.col("z")
    base = (
        region.withColumn("y", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
        .withColumn("z", F.explode(F.array(F.lit("a"), F.lit("b"))))
        .where(~((r == 3) & (y == 1996)))
        .withColumn("twin", F.explode(
            F.when((r == 2) & (y == 1998), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ))
    )
    weights = F.struct(*[F.lit(v).alias(k) for k, v in RISK_WEIGHTS.items()])
    levels = F.struct(*[F.lit(v).alias(k) for k, v in RISK_THRESHOLDS.items()])
    return base.select(
        F.concat_ws("-", F.lit("rules"), r.cast("string"), z, y.cast("string"), F.col("twin").cast("string"))
        .alias("rule_set_id"),
        F.lit("1.0.0").alias("rule_version"),
        F.lit("1.0.0").alias("risk_threshold_version"),
        _id("mun", r).alias("municipality_id"),
        F.concat(F.lit("zone-"), z).alias("zone"),
        F.make_date(y, F.lit(1), F.lit(1)).alias("effective_from"),
        F.when(y < 2001, F.make_date(y, F.lit(12), F.lit(31))).alias("effective_until"),
        F.when(y % 3 != 0, 0.2 + (y % 4) * 0.125).alias("maximum_site_coverage"),
        (y % 4 + 3).cast("double").alias("setback_metres"),
        F.lit(100.0).alias("changed_area_reference"),
        (180 + (r * 30)).cast("int").alias("evidence_freshness_days"),
        levels.alias("thresholds"),
        weights.alias("weights"),
    )


def public_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """Road edges: vertical lines across the lattice."""
    k = F.col("n_nationkey")
    x = (k * 256 % 6400 + 20).cast("double")
    return table(spark, root, "nation").select(
        F.concat(F.lit("road-edge-"), F.lpad(k.cast("string"), 3, "0")).alias("boundary_id"),
        F.lit("road_edge").alias("boundary_type"),
        G.box(x, F.lit(0.0), x, F.lit(24000.0)).alias("box"),
        F.lit(CRS).alias("crs"),
    )


def complaints(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("user_id") * 10 + F.col("event_id") % 10
    code = (F.floor(F.col("value") * 100) % 65536).cast("long")
    return table(spark, root, "events").select(
        F.col("event_id").alias("ordinal"),
        _id("complaint", F.col("event_id")).alias("complaint_id"),
        _id("parcel", k).alias("parcel_id"),
        (lattice_x(k) + 5 + F.col("value")).alias("x"),
        (lattice_y(k) + 5 + F.col("event_id") % 40).alias("y"),
        F.col("ts").alias("received_at"),
        F.col("event_type").alias("description"),
        F.sha2("props", 256).alias("media_sha256"),
        F.repeat(F.lpad(F.lower(F.hex(code)), 4, "0"), 4).alias("perceptual_hash"),
        F.lit(CRS).alias("crs"),
    )


def assets(spark: SparkSession, root: str) -> DataFrame:
    """One raster asset per document: content hash, capture and ingest time, extent, size."""
    d = F.col("doc_id")
    captured = F.timestamp_add("DAY", (d % 700).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    x = (d % 40 * 50).cast("double")
    size = 64.0 + d % 5 * 16
    return table(spark, root, "documents").select(
        d.alias("ordinal"),
        _id("asset", d).alias("asset_id"),
        _id("mun", d % 5).alias("municipality_id"),
        F.col("source"),
        captured.alias("capture_time"),
        F.timestamp_add("HOUR", F.when(d % 37 == 0, -3).otherwise(5), captured).alias("ingestion_time"),
        F.lit(CRS).alias("crs"),
        F.when(d % 41 == 0, "EPSG:4326").otherwise(CRS).alias("box_crs"),
        (0.5 + d % 4 * 0.5).alias("resolution_m"),
        G.box(x, F.lit(0.0), x + size, size).alias("box"),
        F.sha2("text", 256).alias("content_sha256"),
        F.when(d % 9 == 0, 1).when(d % 13 == 0, 4).otherwise(3).alias("band_count"),
        F.col("n_chars").alias("byte_size"),
    )


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """8x8 raster per vector: three 8-bit bands, a validity flag and a building mask."""
    e = F.col("v").cast("double")
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e * 400 + 128))).cast("int")
    return (
        table(spark, root, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("i", "v"))
        .select(
            F.col("vec_id").alias("raster_id"),
            F.floor(F.col("i") / 8).cast("int").alias("row"),
            (F.col("i") % 8).cast("int").alias("col"),
            g.alias("b1"),
            (g * 3 % 256).cast("int").alias("b2"),
            ((g + F.col("i") * 5) % 256).cast("int").alias("b3"),
            ((F.col("vec_id") + F.col("i")) % 23 != 0).alias("valid"),
            (e > 0.03).cast("int").alias("mask"),
            (e > 0.06).cast("int").alias("strict_mask"),
        )
    )


def raster_meta(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("vec_id")
    x = (v % 50 * 14).cast("double")
    return table(spark, root, "embeddings").select(
        v.alias("raster_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.when(v % 31 == 0, 2).otherwise(3).alias("band_count"),
        F.when(v % 29 == 0, F.array(F.lit("blue"), F.lit("green"), F.lit("red")))
        .otherwise(F.array(F.lit("red"), F.lit("green"), F.lit("blue"))).alias("channel_order"),
        F.array(F.lit(2.0), F.lit(0.0), x, F.lit(0.0), F.lit(-2.0), F.lit(200.0)).alias("transform"),
        G.box(x, F.lit(184.0), x + 16, F.lit(200.0)).alias("box"),
        F.lit(CRS).alias("crs"),
        F.lit(2.0).alias("resolution_m"),
    )


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """Rasters 2k and 2k+1 as the old and the new image of one place."""
    v, lab = F.col("vec_id"), F.col("label")
    return (
        table(spark, root, "embeddings").select("vec_id", "label").where(v % 2 == 0)
        .select(
            F.floor(v / 2).alias("pair_id"),
            v.alias("old_id"),
            (v + 1).alias("new_id"),
            (0.2 + (lab * 0.08)).alias("score"),
            (lab == 7).alias("off_nadir"),
            (v % 34 != 0).alias("transform_plausible"),
            F.when(v % 38 == 0, 0.0).otherwise(0.9).alias("overlap_ratio"),
            F.lit(4.0).alias("pixel_area"),
            F.slice(F.array(F.lit("VISUAL_REFINEMENT_SKIPPED"), F.lit("EXTREME_DARKNESS")),
                    F.lit(1), (v % 3).cast("int")).alias("warnings"),
            F.when(lab < 5, "train").when(lab < 8, "validation").otherwise("test").alias("split"),
        )
    )


def pair_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Old and new pixel of every place side by side; label mask from the strict masks."""
    px = pixels(spark, root).withColumn("pair_id", F.floor(F.col("raster_id") / 2))
    is_old = F.col("raster_id") % 2 == 0

    def side(c: str, old: bool) -> Column:
        return F.max(F.when(is_old if old else ~is_old, F.col(c)))

    names = ("b1", "b2", "b3", "mask", "strict_mask", "valid")
    aggs = [side(c, True).alias(f"old_{c}") for c in names] + [side(c, False).alias(f"new_{c}") for c in names]
    wide = px.groupBy("pair_id", "row", "col").agg(*aggs)
    o, n = F.col("old_strict_mask"), F.col("new_strict_mask")
    return wide.withColumn(
        "target", F.when((n == 1) & (o == 0), 1).when((o == 1) & (n == 0), 2).otherwise(0)
    ).drop("old_strict_mask", "new_strict_mask")


def tiles(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("vec_id")
    x = (v % 50 * 14).cast("double")
    y = (F.floor(v / 50) * 20).cast("double")
    return table(spark, root, "embeddings").select(
        F.format_string("tile-%06d", v).alias("tile_id"),
        F.concat_ws("-", F.lit("region"), F.col("label").cast("string"),
                    F.floor(v / 10).cast("string")).alias("region_group"),
        G.box(x, y, x + 8 + v % 7, y + 16).alias("box"),
        F.sha2(F.concat_ws(",", F.transform("embedding", lambda e: F.floor(e * 20).cast("string"))), 256)
        .alias("tile_sha256"),
        F.when(v % 10 < 7, "train").when(v % 10 == 7, "validation").otherwise("test").alias("split"),
        F.lit(CRS).alias("crs"),
    )


def case_actions(spark: SparkSession, root: str) -> DataFrame:
    """Action log of a case: the turn is the arrival sequence, the text picks the action."""
    return as_actions(table(spark, root, "conversations"))


def as_actions(conversations: DataFrame) -> DataFrame:
    c, t, n = F.col("conv_id"), F.col("turn"), F.length("text")
    plan = F.array(*[F.lit(a) for a in (
        "create", "transition:TRIAGED", "assign", "transition:UNDER_REVIEW", "note",
        "transition:REINSPECTION_REQUIRED", "transition:DISMISSED", "transition:CLOSED",
    )])
    noise = F.array(*[F.lit(a) for a in (
        "note", "unassign", "reassign", "evidence", "transition:CONFIRMED_FOR_ADMIN_REVIEW",
    )])
    picked = F.when((n % 6 == 0) & (t > 0), F.get(noise, (n % 5).cast("int"))).otherwise(
        F.get(plan, F.least(t, F.lit(7)).cast("int")))
    role = (
        F.when((t == 0) | (n % 7 < 3), "supervisor").when(n % 7 < 5, "administrator").otherwise("inspector")
    )
    late = F.when(n % 19 == 0, -90).otherwise(0)
    return conversations.select(
        _id("case", c).alias("case_id"),
        t.alias("seq"),
        F.timestamp_add(
            "MINUTE", (c * 7 + t * 60 + late).cast("int"), F.lit("2024-03-01").cast("timestamp")
        ).alias("ts"),
        F.when(role == "inspector", F.concat(F.lit("insp-"), (n % 2).cast("string")))
        .otherwise(F.concat(F.lit("act-"), role)).alias("actor_id"),
        role.alias("actor_role"),
        F.split_part(picked, F.lit(":"), F.lit(1)).alias("action"),
        F.split_part(picked, F.lit(":"), F.lit(2)).alias("target"),
        F.concat(F.lit("insp-"), (n % 2).cast("string")).alias("inspector_id"),
        (n % 17 != 0).alias("inspector_active"),
        F.when(n % 23 == 0, " ").otherwise(F.concat(F.lit("turn "), t.cast("string"))).alias("reason"),
        F.sha2("text", 256).alias("details_sha256"),
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    """Processing requests; repeats of (user, type, props) carry the same key."""
    return table(spark, root, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.concat(F.lit("pair-"), F.col("user_id").cast("string")).alias("image_pair_id"),
        F.sha2("props", 256).alias("config_hash"),
        F.col("event_type").alias("model_version"),
        F.lit("1.0.0").alias("rule_set_version"),
        F.lit("process_pair").alias("operation"),
        F.array(F.sha2(F.concat(F.lit("old-"), F.col("user_id").cast("string")), 256),
                F.sha2(F.concat(F.lit("new-"), F.col("user_id").cast("string")), 256))
        .alias("source_hashes"),
        F.col("value"),
    )


# ---------------------------------------------------------------- tables with planted faults

REFERENCE_TIME = "1998-06-15 12:00:00"


def faulty_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The eleven entities with known faults: shifted wards, bad dates, copies, broken links."""
    land = parcels(spark, root)
    b = F.col("box")

    def extent(by: str) -> DataFrame:
        return land.groupBy(by).agg(F.struct(
            F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"),
            F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y")).alias("box"))

    region, nation = table(spark, root, "region"), table(spark, root, "nation")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    towns = region.select(_id("mun", r).alias("municipality_id"), _id("code", r).alias("code"), "r_regionkey").join(
        extent("municipality_id"), "municipality_id").select(
        "municipality_id", "code",
        G.box(b["min_x"], b["min_y"], F.when(r == 4, b["min_x"] - 1).otherwise(b["max_x"]), b["max_y"]).alias("box"),
        F.lit(CRS).alias("crs"))
    wards = nation.select(
        _id("ward", n).alias("ward_id"), _id("mun", F.when(n == 7, 99).otherwise(F.col("n_regionkey"))).alias("municipality_id"),
        "n_nationkey",
    ).join(extent("ward_id"), "ward_id").select(
        "ward_id", "municipality_id",
        G.box(b["min_x"] - F.when(n == 9, 1000).otherwise(0), b["min_y"],
              b["max_x"] - F.when(n % 5 == 3, 100).otherwise(0), b["max_y"]).alias("box"),
        F.when(n == 11, "EPSG:4326").otherwise(CRS).alias("crs"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    buildings = table(spark, root, "customer").select(
        _id("bld", c).alias("building_id"), _id("parcel", c).alias("parcel_id"),
        _id("fp", F.when(c % 17 == 0, c + 1).otherwise(c)).alias("footprint_id"),
        F.lit(2).alias("approved_floor_count"),
    ).where(F.col("building_id") != "bld-13")
    start = F.to_date("o_orderdate")
    until = F.date_add(start, (F.when(o % 101 == 0, -1).otherwise(30 + o % 11 * 30)).cast("int"))
    day = F.lit(REFERENCE_TIME).cast("timestamp").cast("date")
    told = F.when((until < day) | (start > day), "expired").otherwise("active")
    plan = table(spark, root, "orders").select(
        _id("permit", o).alias("permit_id"), _id("parcel", F.col("o_custkey")).alias("parcel_id"),
        _id("fp", F.col("o_custkey")).alias("footprint_id"),
        (1 + (F.col("o_custkey") + F.when(o % 19 == 0, 1).otherwise(0)) % 2).cast("int").alias("plan_version"),
        start.alias("valid_from"), until.alias("valid_until"),
        F.when(o % 97 == 0, "active").otherwise(told).alias("status"))
    s = F.col("s_suppkey")
    inspectors = table(spark, root, "supplier").select(
        _id("insp", s).alias("inspector_id"), _id("team", s % 5).alias("team_code"), (s % 3 != 0).alias("active"))
    k = F.col("o_custkey")
    cases = table(spark, root, "orders").select(
        _id("seed", o).alias("case_id"), _id("parcel", k).alias("parcel_id"), _id("bld", k).alias("building_id"),
        _id("permit", o).alias("permit_id"), _id("insp", o % 12).alias("inspector_id"),
        F.array(_id("asset", o % 150), _id("asset", o % 170)).alias("imagery_asset_ids"),
        F.when(o % 2 == 0, F.array(_id("complaint", o % 900))).otherwise(F.array().cast("array<string>"))
        .alias("complaint_ids"),
        footprint_box(k).alias("observed_footprint"), F.lit(1).alias("observed_floor_count"),
        F.lit("seeded").alias("status"))
    return {
        "municipalities": towns, "wards": wards, "parcels": land, "approved_buildings": buildings,
        "approved_footprints": approved_footprints(spark, root), "permits": plan,
        "imagery_assets": assets(spark, root),
        "complaints": complaints(spark, root).withColumn("category", F.lit("construction_change")),
        "inspectors": inspectors, "inspection_cases": cases,
        "public_boundaries": public_boundaries(spark, root),
    }
