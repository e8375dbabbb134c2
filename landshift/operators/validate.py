"""Contract and relationship validation with quarantine.

Every rejected record gets exactly one row and the first reason wins. Links form a chain
(municipalities, wards, parcels, footprints and buildings, permits, complaints, cases), so the
fixpoint is reached by a fixed sequence of joins on keys; nothing iterates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import boxes as G
from landshift.functions.scalars import codes
from landshift.operators.rings import ring_faults
from landshift.session import cut_lineage

KEYS = {
    "municipalities": "municipality_id", "wards": "ward_id", "parcels": "parcel_id",
    "approved_buildings": "building_id", "approved_footprints": "footprint_id",
    "permits": "permit_id", "imagery_assets": "asset_id", "complaints": "complaint_id",
    "inspectors": "inspector_id", "inspection_cases": "case_id", "public_boundaries": "boundary_id",
}

#: Entities that may carry an outline, and the box that stands for it.
RINGED = {
    "municipalities": "box", "wards": "box", "parcels": "box", "approved_footprints": "box", "inspection_cases": "observed_footprint",
}
ENTITY_ID = r"^[a-z0-9][a-z0-9._-]+$"
HEX64 = r"^[0-9a-f]{64}$"


def _reason(stage: str, *rules: tuple[Column, str]) -> Column:
    """Struct(reason, stage) of the first rule that holds, else null."""
    return F.coalesce(*[
        F.when(cond, F.struct(F.lit(code).alias("reason"), F.lit(stage).alias("stage"))) for cond, code in rules
    ])


def _parent(df: DataFrame, key: str, alias: str, *cols: str) -> DataFrame:
    """Parent rows as one struct column, with whether they were rejected; of a repeated id the last row counts.

    Without further columns the aggregate is on plain values, which Spark combines by hash and not by sorting all rows.
    """
    if not cols:
        last = F.coalesce("ordinal", F.lit(-(2**63))) if "ordinal" in df.columns else F.xxhash64(key)
        return df.groupBy(F.col(key).alias(f"_{alias}_key")).agg(
            F.max_by(F.col("_r").isNull(), last).alias("ok")).select(f"_{alias}_key", F.struct("ok").alias(f"_{alias}"))
    order = F.struct(*[F.col(c) for c in ("ordinal",) if c in df.columns], F.xxhash64(key, *cols))
    return df.groupBy(F.col(key).alias(f"_{alias}_key")).agg(
        F.max_by(F.struct(F.col("_r").isNull().alias("ok"), *cols), order).alias(f"_{alias}"))


def _attach(child: DataFrame, parent: DataFrame, alias: str, on: str) -> DataFrame:
    return child.join(parent, F.col(on) == F.col(f"_{alias}_key"), "left").drop(f"_{alias}_key")


def _bad(alias: str) -> Column:
    return F.col(f"_{alias}").isNull() | ~F.col(f"_{alias}.ok")


def _settle(df: DataFrame, *reasons: Column) -> DataFrame:
    """Fix ``_r`` to the first given reason and store the judged rows once.

    Children and both outputs read the stored rows, so no parent is judged twice.
    """
    plain = [c for c in df.columns if not c.startswith("_")]
    return cut_lineage(df.select(*plain, F.coalesce(*reasons).alias("_r")))


def _bad_geometry(column: str = "box") -> Column:
    return _reason("contract", (~G.is_valid(F.col(column)), "INVALID_GEOMETRY"))


def _without_rings(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with an outline ``ring``: the box of a faulty ring is void, so its geometry fails the contract. Boxes alone stay as they are."""
    out = dict(tables)
    for name, column in RINGED.items():
        if name in out and "ring" in out[name].columns:
            df = out[name].withColumn("_ring", F.xxhash64(KEYS[name], F.to_json("ring")))
            faulty = ring_faults(df.select("_ring", "ring").dropDuplicates(["_ring"]), "_ring").withColumn("_faulty", F.lit(True))
            void = F.when(F.col("_faulty").isNull(), F.col(column))
            out[name] = df.join(faulty.drop("fault"), "_ring", "left").withColumn(column, void).drop("_ring", "_faulty")
    return out


def _inside_parent(df: DataFrame, parent: DataFrame, on: str, missing: str, outside: str) -> DataFrame:
    """Contract check, then parent exists and is valid, same CRS, and covers the child."""
    joined = _attach(df, _parent(parent, on, "p", "box", "crs"), "p", on)
    return _settle(joined, _bad_geometry(), _reason(
        "relationship", (_bad("p"), missing), (F.col("crs") != F.col("_p.crs"), "CRS_MISMATCH"),
        (~G.covers(F.col("_p.box"), F.col("box")), outside),
    ))


def _assets(df: DataFrame) -> DataFrame:
    """The first asset of a content hash stays, even where it was rejected itself.

    The first one is a grouped minimum (combined before the shuffle), not a ranking window, so a
    group of copies never has to be sorted in one task. A missing hash is a fault of its own and no copy.
    The rows are stored first, so that contents are hashed once.
    """
    df = cut_lineage(df)
    first = df.where("content_sha256 is not null").groupBy(F.col("content_sha256").alias("_sha")).agg(
        F.min("ordinal").alias("_first"))
    joined = df.join(first, F.col("content_sha256") == F.col("_sha"), "left").drop("_sha")
    return _settle(
        joined,
        _reason("contract", (F.col("content_sha256").isNull(), "MISSING_ASSET_HASH"),
                (F.col("capture_time") > F.col("ingestion_time"), "INVALID_CAPTURE_TIME"),
                (F.col("box_crs") != F.col("crs"), "CRS_MISMATCH")),
        _reason("deduplication", (F.col("ordinal") > F.col("_first"), "DUPLICATE_ASSET_HASH")),
    )


def _permit_dates(at: Column) -> Column:
    start, end, day = F.col("valid_from"), F.col("valid_until"), F.to_date(at)
    wrong = ((F.col("status") == "active") & ~day.between(start, end)) | (
        (F.col("status") == "expired") & (end >= day)
    )
    return _reason("contract", (start > end, "INVALID_PERMIT_DATES"), (wrong, "PERMIT_STATUS_DATE_MISMATCH"))


def judge(tables: dict[str, DataFrame], at: Column) -> dict[str, DataFrame]:
    """Every entity with ``_r``: struct(reason, stage) of its rejection, or null."""
    out: dict[str, DataFrame] = {}
    tables = _without_rings(tables)
    out["municipalities"] = _settle(tables["municipalities"], _bad_geometry())
    out["public_boundaries"] = _settle(tables["public_boundaries"], _reason(
        "contract", (F.col("box")["min_x"] > F.col("box")["max_x"], "INVALID_GEOMETRY")))
    out["wards"] = _inside_parent(
        tables["wards"], out["municipalities"], "municipality_id", "MISSING_MUNICIPALITY", "OUTSIDE_MUNICIPALITY")
    out["parcels"] = _inside_parent(tables["parcels"], out["wards"], "ward_id", "MISSING_WARD", "OUTSIDE_WARD")
    out["imagery_assets"] = _assets(tables["imagery_assets"])
    out["inspectors"] = tables["inspectors"].withColumn("_r", F.lit(None).cast("struct<reason:string,stage:string>"))
    parcel = cut_lineage(_parent(out["parcels"], "parcel_id", "p", "box", "crs", "setback_m"))

    known = tables["approved_buildings"].select(F.col("building_id").alias("_b_key"), F.lit(True).alias("_b")).distinct()
    local = _attach(_attach(tables["approved_footprints"], parcel, "p", "parcel_id"), known, "b", "building_id")
    allowed = G.inset(F.col("_p.box"), F.col("_p.setback_m"))
    local = _settle(local, _bad_geometry(), _reason(
        "relationship", (_bad("p"), "MISSING_PARCEL"), (F.col("_b").isNull(), "MISSING_BUILDING"),
        (F.col("crs") != F.col("_p.crs"), "CRS_MISMATCH"),
        (G.is_empty(allowed) | ~G.covers(allowed, F.col("box")), "BUILDING_OUTSIDE_PARCEL"),
    ))
    linked = _attach(
        _attach(tables["approved_buildings"], parcel, "p", "parcel_id"),
        _parent(local, "footprint_id", "f", "building_id", "parcel_id"), "f", "footprint_id")
    out["approved_buildings"] = _settle(linked, _reason(
        "relationship", (_bad("p"), "MISSING_PARCEL"),
        (_bad("f") | (F.col("_f.building_id") != F.col("building_id"))
         | (F.col("_f.parcel_id") != F.col("parcel_id")), "INVALID_FOOTPRINT_LINK"),
    ))
    fallen = _attach(local, _parent(out["approved_buildings"], "building_id", "b"), "b", "building_id")
    out["approved_footprints"] = _settle(
        fallen, F.col("_r"), _reason("relationship", (~F.col("_b.ok"), "MISSING_BUILDING")))

    permit = _attach(
        _attach(tables["permits"], parcel, "p", "parcel_id"),
        _parent(out["approved_footprints"], "footprint_id", "f", "plan_version"), "f", "footprint_id")
    out["permits"] = _settle(permit, _permit_dates(at), _reason(
        "relationship", (_bad("p"), "MISSING_PARCEL"),
        (_bad("f") | (F.col("plan_version") != F.col("_f.plan_version")), "INVALID_PLAN_LINK"),
    ))
    x, y = F.col("x"), F.col("y")
    point = G.point_box(x, y)
    finite = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    out["complaints"] = _settle(
        _attach(tables["complaints"], parcel, "p", "parcel_id"),
        _reason("contract", (~finite, "INVALID_COMPLAINT_COORDINATE")),
        _reason("relationship", (_bad("p"), "MISSING_PARCEL"), (F.col("crs") != F.col("_p.crs"), "CRS_MISMATCH"),
                (~G.covers(F.col("_p.box"), point), "OUTSIDE_PARCEL")),
    )
    out["inspection_cases"] = _cases(tables["inspection_cases"], out)
    return out


def _cases(cases: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """Single links by joins. Of the id arrays, the ids that name no kept row are found first, each once and not once
    per case; only the cases that use one of them are then joined. Both lists are stored, so a short one is broadcast."""
    df, broken = cases, None
    for alias, entity, key in (
        ("p", "parcels", "parcel_id"), ("b", "approved_buildings", "building_id"),
        ("m", "permits", "permit_id"), ("i", "inspectors", "inspector_id"),
    ):
        df = _attach(df, _parent(done[entity], key, alias), alias, key)
    for entity, key, ids in (("imagery_assets", "asset_id", "imagery_asset_ids"), ("complaints", "complaint_id", "complaint_ids")):
        used = cases.select("case_id", F.explode(ids).alias("_id"))
        kept = done[entity].where(F.col("_r").isNull()).select(F.col(key).alias("_id"))
        gone = cut_lineage(used.select("_id").distinct().join(kept, "_id", "left_anti").withColumnRenamed("_id", "_gone"))
        part = used.join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_semi").select("case_id")
        broken = part if broken is None else broken.unionByName(part)
    df = df.join(cut_lineage(broken.distinct().withColumn("_broken", F.lit(True))), "case_id", "left")
    missing = (
        _bad("p") | _bad("b") | _bad("m") | F.col("_i").isNull() | F.col("_broken").isNotNull()
    )
    return _settle(df, _bad_geometry("observed_footprint"),
                   _reason("relationship", (missing, "INVALID_CASE_RELATIONSHIP")))


def validate(tables: dict[str, DataFrame], batch_id: str, at: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, quarantine); input count = kept count + quarantined count per entity."""
    done = judge(tables, at)
    kept = {name: df.where(F.col("_r").isNull()).drop("_r") for name, df in done.items()}
    parts = [
        df.where(F.col("_r").isNotNull()).select(
            F.concat(F.lit(f"{name}:"), F.col(KEYS[name])).alias("original_record_reference"),
            F.col("_r.reason").alias("reason_code"), F.col("_r.stage").alias("validation_stage"),
            at.alias("timestamp"), F.lit(batch_id).alias("source_batch_id"),
        )
        for name, df in done.items()
    ]
    quarantine = parts[0]
    for part in parts[1:]:
        quarantine = quarantine.unionByName(part)
    return kept, quarantine


def _bad_id(name: str) -> Column:
    c = F.col(name)
    return ~F.coalesce(F.length(c).between(3, 96) & c.rlike(ENTITY_ID), F.lit(False))


def _not(cond: Column) -> Column:
    return ~F.coalesce(cond, F.lit(False))


def _one_of(name: str, *values: str) -> Column:
    return _not(F.col(name).isin(*values))


def field_rules(entity: str) -> list[tuple[Column, str]]:
    """Field constraints of an entity as (violated, code)."""
    c = F.col
    ids = {
        "municipalities": ("municipality_id", "code"), "wards": ("ward_id", "municipality_id"),
        "parcels": ("parcel_id", "ward_id"), "approved_buildings": ("building_id", "parcel_id", "footprint_id"),
        "approved_footprints": ("footprint_id", "building_id", "parcel_id"),
        "permits": ("permit_id", "parcel_id", "footprint_id"), "imagery_assets": ("asset_id",),
        "complaints": ("complaint_id", "parcel_id"), "inspectors": ("inspector_id", "team_code"),
        "public_boundaries": ("boundary_id",),
        "inspection_cases": ("case_id", "parcel_id", "building_id", "permit_id", "inspector_id"),
        "evidence_assets": (),
    }[entity]
    rules = [(_bad_id(name), f"ID:{name}") for name in ids]
    more: dict[str, list[tuple[Column, str]]] = {
        "parcels": [(_not(c("setback_m") >= 0), "RANGE:setback_m")],
        "approved_buildings": [(_not(c("approved_floor_count") > 0), "RANGE:approved_floor_count")],
        "approved_footprints": [(_not(c("plan_version") > 0), "RANGE:plan_version")],
        "permits": [
            (_not(c("plan_version") > 0), "RANGE:plan_version"),
            (_one_of("status", "active", "expired"), "ENUM:status"),
            (_not(c("valid_from") <= c("valid_until")), "ORDER:valid_from"),
        ],
        "imagery_assets": [
            (_not(F.length("source") >= 1), "LENGTH:source"),
            (_not(c("resolution_m") > 0), "RANGE:resolution_m"),
            (_not(c("content_sha256").rlike(HEX64)), "PATTERN:content_sha256"),
            (_not(c("capture_time") <= c("ingestion_time")), "ORDER:capture_time"),
            (_not(c("box_crs") == c("crs")), "EQUAL:crs"),
        ],
        "complaints": [
            (_one_of("category", "construction_change", "possible_encroachment"), "ENUM:category"),
            (F.length("description") > 2000, "LENGTH:description"),
            (c("media_sha256").isNotNull() & _not(c("media_sha256").rlike(HEX64)), "PATTERN:media_sha256"),
            (c("perceptual_hash").isNotNull() & _not(c("perceptual_hash").rlike("^[0-9a-fA-F]+$")),
             "PATTERN:perceptual_hash"),
        ],
        "public_boundaries": [(_one_of("boundary_type", "road_edge", "municipal_boundary"), "ENUM:boundary_type")],
        "inspection_cases": [
            (_not(F.size("imagery_asset_ids") >= 1), "LENGTH:imagery_asset_ids"),
            (_not(c("observed_floor_count") > 0), "RANGE:observed_floor_count"),
            (_one_of("status", "seeded", "review_pending", "closed"), "ENUM:status"),
        ],
        "evidence_assets": [
            (_not(c("original_asset_sha256").rlike(HEX64)), "PATTERN:original_asset_sha256"),
            (_not(c("capture_time") <= c("ingestion_time")), "ORDER:capture_time"),
            ((c("kind") == "original")
             & (c("derived_asset_sha256").isNotNull() | c("source_asset_id").isNotNull()), "ORIGINAL_WITH_SOURCE"),
            ((c("kind") == "derived")
             & (c("derived_asset_sha256").isNull() | c("source_asset_id").isNull()
                | c("processing_job_id").isNull() | c("model_version").isNull()), "DERIVED_INCOMPLETE"),
        ],
    }
    return rules + more.get(entity, [])


def violations(df: DataFrame, entity: str) -> DataFrame:
    """All violated field constraints of a row, and the first of them."""
    found = df.withColumn("violations", codes(*field_rules(entity)))
    return found.withColumn("first_code", F.get("violations", F.lit(0)))
