"""Defaults and code lists that must equal the published ones."""

# --- fixed values: complaint grouping ---
COMPLAINT_METRES = 25.0
COMPLAINT_DAYS = 7
TEXT_SIMILARITY = 0.82
HASH_DISTANCE = 6

# --- fixed values: risk weights, thresholds, rule defaults ---
RISK_WEIGHTS = {
    "change_confidence": 20.0,
    "changed_area": 10.0,
    "unapproved_added_area": 35.0,
    "permit_not_found": 20.0,
    "wrong_plan_version": 15.0,
    "parcel_boundary_crossing": 15.0,
    "complaint_corroboration": 10.0,
    "coverage_exceeded": 15.0,
    "setback_intersection": 10.0,
    "public_boundary_intersection": 10.0,
    "medium_registration_penalty": 10.0,
    "quality_warning_penalty": 5.0,
    "stale_evidence_penalty": 8.0,
}
# Factor codes in the order in which they are listed.
RISK_FACTORS = (
    "CHANGE_CONFIDENCE", "CHANGED_AREA", "UNAPPROVED_ADDED_AREA", "WRONG_PLAN_VERSION", "ACTIVE_PERMIT_NOT_FOUND",
    "PARCEL_BOUNDARY_REVIEW", "COMPLAINT_CORROBORATION", "SITE_COVERAGE_EXCEEDED", "SETBACK_ZONE_INTERSECTION",
    "PUBLIC_BOUNDARY_INTERSECTION", "REGISTRATION_QUALITY_PENALTY", "IMAGE_QUALITY_PENALTY", "STALE_EVIDENCE_PENALTY",
)
RISK_THRESHOLDS = {"medium": 25.0, "high": 50.0, "critical": 75.0}
AREA_REFERENCE_M2 = 100.0
FRESHNESS_DAYS = 180
AREA_EPSILON = 1e-9
REGISTRATION_GOOD = 0.8

# --- fixed values: change labels ---
NO_CHANGE, ADDED, REMOVED, EXPANSION, PARTIAL_DEMOLITION, UNCERTAIN = 0, 1, 2, 3, 4, 5

# --- fixed values: change detection ---
IMAGE_DIFFERENCE = {
    "threshold": 0.15, "penalty": 0.1, "kernel": 3, "min_region": 8, "min_score": 0.25,
}
MASK_DIFFERENCE = {"min_region": 4, "adjacency": 1, "min_score": 0.25}
CONFIDENCE = {"warning_penalty": 0.08, "min_region": 8, "full_region": 64}
SSIM_C1 = 0.01**2
SSIM_C2 = 0.03**2

# --- fixed values: evaluation ---
OBJECT_OVERLAP = 0.25
SMALL_OBJECT_PIXELS = 64
TIER_HIGH = 0.8
TIER_MEDIUM = 0.55
BOUNDARY_TOLERANCE = 1

# --- fixed values: geographic split ---
SPLIT_SEED = 17
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15

# --- fixed values: training ---
SIAMESE = {"rate": 0.2, "epochs": 40, "threshold": 0.5}
SEGMENTATION = {"rate": 0.1, "epochs": 30, "patience": 5, "min_delta": 1e-5}

# --- fixed values: raster quality and registration ---
QUALITY = {
    "min_side": 64, "bands": (1, 3, 4), "blur": 20.0, "dark": 12, "bright": 243,
    "exposure": 0.9, "valid": 0.8, "overlap": 0.2, "resolution_ratio": 4.0,
}
REGISTRATION = {
    "feature_ratio": 0.78, "ransac_px": 3.0, "min_inliers": 8, "min_inlier_ratio": 0.2,
    "max_error": 4.0, "max_rotation": 15.0, "max_scale": 0.3, "max_translation": 0.35,
    "max_perspective": 0.001, "min_score": 0.5, "low_percentile": 2.0, "high_percentile": 98.0,
}
QUALITY_STATUSES = ("PASS", "PASS_WITH_WARNING", "REQUIRES_MANUAL_ALIGNMENT", "REJECTED")

# --- fixed values: case workflow ---
CASE_STATES = (
    "CREATED", "TRIAGED", "ASSIGNED", "UNDER_REVIEW", "REINSPECTION_REQUIRED",
    "EVIDENCE_INSUFFICIENT", "DISMISSED", "CONFIRMED_FOR_ADMIN_REVIEW", "CLOSED",
)
CASE_TRANSITIONS = {
    "CREATED": ("TRIAGED",),
    "TRIAGED": ("DISMISSED", "EVIDENCE_INSUFFICIENT"),
    "ASSIGNED": ("UNDER_REVIEW", "REINSPECTION_REQUIRED", "EVIDENCE_INSUFFICIENT", "DISMISSED"),
    "UNDER_REVIEW": (
        "REINSPECTION_REQUIRED", "EVIDENCE_INSUFFICIENT", "DISMISSED", "CONFIRMED_FOR_ADMIN_REVIEW",
    ),
    "REINSPECTION_REQUIRED": ("UNDER_REVIEW", "EVIDENCE_INSUFFICIENT", "DISMISSED"),
    "EVIDENCE_INSUFFICIENT": ("REINSPECTION_REQUIRED", "UNDER_REVIEW", "DISMISSED"),
    "DISMISSED": ("CLOSED",),
    "CONFIRMED_FOR_ADMIN_REVIEW": ("CLOSED",),
    "CLOSED": (),
}
ASSIGNABLE = ("TRIAGED", "REINSPECTION_REQUIRED", "EVIDENCE_INSUFFICIENT")
SETTLED = ("DISMISSED", "CONFIRMED_FOR_ADMIN_REVIEW", "CLOSED")
SUPERVISORS = ("supervisor", "administrator")
HUMANS = ("inspector", "supervisor", "administrator")

# --- fixed values: terms that mark sensitive metadata ---
SECRET_TERMS = (
    "password", "secret", "token", "credential", "api_key", "access_key", "private_key",
    "authorization",
)
PERSONAL_TERMS = ("address", "citizen", "email", "image", "name", "phone", "token")
LOG_TEXT_LIMIT = 256

# --- fixed values: failure kinds -> (code, transient) ---
FAILURE_CODES = {
    "raster_read": ("INVALID_RASTER", False),
    "raster_metadata": ("INVALID_RASTER", False),
    "crs_missing": ("MISSING_CRS", False),
    "crs_mismatch": ("CRS_MISMATCH", False),
    "insufficient_overlap": ("INSUFFICIENT_OVERLAP", False),
    "registration_quality": ("REGISTRATION_QUALITY_TOO_LOW", False),
    "registration": ("REGISTRATION_FAILED", False),
    "geometry": ("INVALID_GEOMETRY", False),
    "model_missing": ("MODEL_NOT_AVAILABLE", False),
    "model_checksum": ("MODEL_CHECKSUM_MISMATCH", False),
    "model_schema": ("MODEL_SCHEMA_MISMATCH", False),
    "rule_set": ("RULE_SET_NOT_AVAILABLE", False),
    "evidence": ("EVIDENCE_INTEGRITY_FAILURE", False),
    "case_transition": ("INVALID_CASE_TRANSITION", False),
    "persistence": ("STORAGE_UNAVAILABLE", True),
    "storage": ("STORAGE_UNAVAILABLE", True),
    "queue": ("STORAGE_UNAVAILABLE", True),
}
FAILURE_DEFAULT = ("PROCESSING_FAILED", False)
