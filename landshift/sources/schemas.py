"""Declared schemas of the entity tables; loading refuses anything else."""

from __future__ import annotations

from pyspark.sql import types as T

from landshift.functions.constants import RISK_THRESHOLDS, RISK_WEIGHTS

BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"

_DDL = {
    "municipalities": f"municipality_id string, code string, box {BOX}, crs string",
    "wards": f"ward_id string, municipality_id string, box {BOX}, crs string",
    "parcels": f"parcel_id string, ward_id string, setback_m double, box {BOX}, crs string",
    "approved_buildings": "building_id string, parcel_id string, footprint_id string, approved_floor_count int",
    "approved_footprints":
        f"footprint_id string, building_id string, parcel_id string, plan_version int, box {BOX}, crs string",
    "permits":
        "permit_id string, parcel_id string, footprint_id string, plan_version int, permit_type string, "
        "valid_from date, valid_until date, status string, applicable_conditions array<string>",
    "imagery_assets":
        "ordinal bigint, asset_id string, source string, capture_time timestamp, ingestion_time timestamp, "
        f"crs string, box_crs string, resolution_m double, box {BOX}, storage_uri string, content_sha256 string, "
        "licence_reference string, quality_status string",
    "complaints":
        "complaint_id string, parcel_id string, x double, y double, crs string, category string, "
        "received_at timestamp, description string, media_sha256 string, perceptual_hash string",
    "inspectors": "inspector_id string, team_code string, active boolean",
    "public_boundaries": f"boundary_id string, boundary_type string, box {BOX}, crs string",
    "inspection_cases":
        "case_id string, scenario string, parcel_id string, building_id string, permit_id string, "
        "imagery_asset_ids array<string>, complaint_ids array<string>, inspector_id string, "
        f"observed_footprint {BOX}, observed_floor_count int, status string",
    "quarantine":
        "original_record_reference string, reason_code string, validation_stage string, timestamp timestamp, "
        "source_batch_id string",
}

_WEIGHTS = ",".join(f"{name}:double" for name in RISK_WEIGHTS)
_THRESHOLDS = ",".join(f"{name}:double" for name in RISK_THRESHOLDS)
# Inputs of the assessment: entities with their load order and place, and what the detectors and rules give.
_ASSESSMENT = {
    "changes":
        f"change_id string, parcel_id string, capture_date date, capture_time timestamp_ntz, plan_version int, box {BOX}, "
        f"old_box {BOX}, new_box {BOX}, change_confidence double, registration_quality double, "
        "quality_warnings array<string>, evaluation_time timestamp_ntz, crs string",
    "parcels":
        f"ordinal bigint, parcel_id string, ward_id string, municipality_id string, zone string, setback_m double, box {BOX}, "
        "crs string",
    "approved_footprints": f"ordinal bigint, {_DDL['approved_footprints']}",
    "permits": "permit_id string, parcel_id string, footprint_id string, plan_version int, valid_from date, valid_until date",
    "rule_sets":
        "rule_set_id string, rule_version string, risk_threshold_version string, municipality_id string, zone string, "
        "effective_from date, effective_until date, maximum_site_coverage double, setback_metres double, "
        "changed_area_reference double, evidence_freshness_days int, "
        f"thresholds struct<{_THRESHOLDS}>, weights struct<{_WEIGHTS}>",
    "public_boundaries": _DDL["public_boundaries"],
    "complaints":
        "ordinal bigint, complaint_id string, parcel_id string, x double, y double, received_at timestamp_ntz, "
        "description string, media_sha256 string, perceptual_hash string, crs string",
}

ENTITIES = tuple(name for name in _DDL if name != "quarantine")


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def assessment_schemas() -> dict[str, T.StructType]:
    """Schemas of the tables that an assessment reads."""
    return {name: T.StructType.fromDDL(ddl) for name, ddl in _ASSESSMENT.items()}
