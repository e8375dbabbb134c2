"""Case workflow: judging actions, snapshots, hash chains, custody, lineage, listing."""

from __future__ import annotations

import math
from hashlib import sha256 as _sha256

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import canonical_json, sha256
from landshift.operators.ordered import ordered_fold
from landshift.session import store

STATE = {"status": "string", "inspector": "string", "updated": "timestamp"}
VERDICT = {"error_code": "string", "previous_status": "string"}


def judge_action(state: dict | None, action: dict) -> tuple[dict | None, dict]:
    """One action against the current state: the new state and the verdict.

    Shared by the batch fold and the stream. A refused action leaves the state as it is.
    """
    before = None if state is None else state["status"]
    error, status, inspector = _decide(state, action)
    if error is None and state is not None and action["ts"] < state["updated"]:
        error = "OUT_OF_ORDER"
    verdict = {"error_code": error, "previous_status": before}
    if error is not None:
        return state, verdict
    return {"status": status, "inspector": inspector, "updated": action["ts"]}, verdict


def _decide(state: dict | None, a: dict) -> tuple[str | None, str | None, str | None]:
    role, kind = a["actor_role"], a["action"]
    if kind == "create":
        if role not in ("system_processor", *K.SUPERVISORS):
            return "ROLE", None, None
        return ("CASE_EXISTS" if state else None), "CREATED", None
    if state is None:
        return "CASE_NOT_FOUND", None, None
    status, holder = state["status"], state["inspector"]
    not_holder = role == "inspector" and holder != a["actor_id"]
    human = "ROLE" if role not in K.HUMANS else "NOT_ASSIGNED_INSPECTOR" if not_holder else None
    if kind == "transition":
        target = a["target"]
        if not (a["reason"] or "").strip():
            return "REASON_REQUIRED", None, None
        if target == "ASSIGNED" or target not in K.CASE_TRANSITIONS[status]:
            return "INVALID_TRANSITION", None, None
        if target == "UNDER_REVIEW" and holder is None:
            return "INSPECTOR_REQUIRED", None, None
        if target in ("TRIAGED", "CONFIRMED_FOR_ADMIN_REVIEW"):
            error = None if role in K.SUPERVISORS else "ROLE"
        elif target == "CLOSED":
            error = None if role == "administrator" else "ROLE"
        else:
            error = human
        return error, target, holder
    if kind in ("assign", "reassign", "unassign"):
        if role not in K.SUPERVISORS:
            return "ROLE", None, None
        if kind != "unassign" and not a["inspector_active"]:
            return "INSPECTOR_INACTIVE", None, None
        if kind == "assign":
            error = "ALREADY_ASSIGNED" if holder else None if status in K.ASSIGNABLE else "NOT_ASSIGNABLE"
            return error, "ASSIGNED", a["inspector_id"]
        error = "NOT_ASSIGNED" if holder is None else "CASE_SETTLED" if status in K.SETTLED else None
        if kind == "reassign":
            return error, status, a["inspector_id"]
        return error, "TRIAGED" if status in ("ASSIGNED", "UNDER_REVIEW") else status, None
    if kind in ("note", "evidence") and status == "CLOSED":
        return "CASE_CLOSED", None, None
    if kind == "note":
        return human, status, holder
    if kind in ("evidence", "verify"):
        return ("NOT_ASSIGNED_INSPECTOR" if not_holder else None), status, holder
    return "UNKNOWN_ACTION", None, None


def judge_actions(actions: DataFrame) -> DataFrame:
    """Verdict and state after every action, in arrival order (seq) within a case."""
    return ordered_fold(actions, "case_id", "seq", judge_action, STATE, VERDICT)


def case_snapshots(judged: DataFrame) -> DataFrame:
    """Latest state per case with counts; a grouped maximum by sequence."""
    ok = F.col("error_code").isNull()
    latest = F.max_by(F.struct("after_status", "after_inspector", "after_updated"), "seq")
    return judged.groupBy("case_id").agg(
        latest.alias("_s"),
        F.min(F.when(ok & (F.col("action") == "create"), F.col("ts"))).alias("created_at"),
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused"),
        F.count_if(ok & (F.col("action") == "note")).alias("notes"),
        F.count_if(ok & F.col("action").isin("assign", "reassign", "unassign")).alias("assignments"),
        F.count_if(ok & (F.col("action") == "evidence")).alias("evidence"),
    ).select("case_id", F.col("_s.after_status").alias("status"), F.col("_s.after_inspector").alias("inspector_id"),
             F.col("_s.after_updated").alias("updated_at"), "created_at", "accepted", "refused", "notes", "assignments", "evidence")


def transition_rules(spark) -> DataFrame:
    """Legal transitions as a dimension table (fixed size)."""
    rows = [(a, b) for a, targets in K.CASE_TRANSITIONS.items() for b in targets]
    return spark.createDataFrame(rows, "from_status string, to_status string")


# ---------------------------------------------------------------- chains

def event_body(fields: dict[str, Column]) -> Column:
    """Digest of the canonical JSON of an event without its chain hashes."""
    return sha256(canonical_json(fields))


def link_hash(previous: Column, body: Column) -> Column:
    return sha256(F.concat(F.coalesce(previous, F.lit("root")), body))


def _link(state: dict | None, row: dict) -> tuple[dict, dict]:
    previous = None if state is None else state["head"]
    digest = _sha256(((previous or "root") + row["body_sha256"]).encode()).hexdigest()
    return {"head": digest}, {"previous_hash": previous, "event_hash": digest}


def build_chain(events: DataFrame) -> DataFrame:
    """Chain of hashes per case over body_sha256 in seq order.

    Bodies are hashed in parallel beforehand; what is sequential by definition is one short hash
    per event.
    """
    out = {"previous_hash": "string", "event_hash": "string"}
    return ordered_fold(events, "case_id", "seq", _link, {"head": "string"}, out).drop("after_head")


def verify_chain(chain: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """First broken event per case, or null; heads (case_id, head_hash) are compared when given.

    Every event is checked on its own: the one before is met by an equi-join on (case, seq), so
    a long case is spread over all tasks. Sequence numbers are dense from zero; a gap breaks.
    """
    before = chain.select("case_id", (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("_prior"))
    joined = chain.join(before, ["case_id", "seq"], "left")
    linked = F.col("previous_hash").eqNullSafe(F.col("_prior")) & (F.col("_prior").isNotNull() | (F.col("seq") == 0))
    sound = F.col("event_hash") == link_hash(F.col("previous_hash"), F.col("body_sha256"))
    per = joined.groupBy("case_id").agg(
        F.count("*").alias("events"), F.min(F.when(~(linked & sound), F.col("seq"))).alias("first_broken"),
        F.max_by("event_hash", "seq").alias("_head"))
    if heads is None:
        return per.withColumn("head_ok", F.lit(True)).drop("_head")
    return per.join(heads, "case_id", "full_outer").withColumn(
        "head_ok", F.col("head_hash").eqNullSafe(F.col("_head"))).drop("_head", "head_hash")


# ---------------------------------------------------------------- evidence

def custody_report(evidence: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Custody error of every evidence asset, in check order.

    ``evidence``: case_id, position, asset_id, content_sha256, original_sha256, source_asset_id.
    ``contents``: asset_id, actual_sha256. Earlier holders of an id or a content are grouped
    minima; sources are met by a join on (case, id). Every asset keeps its row, also without an id or
    a content hash; what is missing is equal to nothing.
    """
    case = F.col("case_id").alias("_case")
    ids = evidence.groupBy(case, F.col("asset_id").alias("_id")).agg(F.min("position").alias("_id_first"))
    same = evidence.where("content_sha256 is not null").groupBy(case, F.col("content_sha256").alias("_sha")).agg(
        F.min("position").alias("_content_first"))
    sources = evidence.groupBy(case, F.col("asset_id").alias("_id")).agg(
        F.max_by("content_sha256", "position").alias("_source_sha"))
    here = F.col("case_id").eqNullSafe(F.col("_case"))
    joined = (
        evidence.join(ids, here & (F.col("asset_id") == F.col("_id")), "left").drop("_case", "_id")
        .join(same, here & (F.col("content_sha256") == F.col("_sha")), "left").drop("_case", "_sha")
        .join(sources, here & (F.col("source_asset_id") == F.col("_id")), "left").drop("_case", "_id")
    )
    has_source = F.col("source_asset_id").isNotNull()
    error = (
        F.when(F.col("position") > F.col("_id_first"), "DUPLICATE_ID")
        .when(F.col("position") > F.col("_content_first"), "DUPLICATE_CONTENT")
        .when(has_source & F.col("_source_sha").isNull(), "MISSING_SOURCE")
        .when(has_source & (F.col("original_sha256") != F.col("_source_sha")), "SOURCE_HASH_MISMATCH")
    )
    if contents is not None:
        joined = joined.join(contents, "asset_id", "left")
        error = F.coalesce(error, content_error())
    return joined.select(*evidence.columns, error.alias("custody_error"))


def content_error() -> Column:
    return F.when(F.col("actual_sha256").isNull(), "CONTENT_UNAVAILABLE").when(
        F.col("actual_sha256") != F.col("content_sha256"), "CONTENT_MISMATCH")


def content_check(evidence: DataFrame, contents: DataFrame) -> DataFrame:
    return evidence.join(contents, "asset_id", "left").withColumn("content_error", content_error())


def lineage_levels(evidence: DataFrame) -> DataFrame:
    """Depth of every asset under its origin; assets that never reach one lie on a cycle.

    Pointer doubling: each round doubles the distance covered, so the rounds grow with the
    logarithm of the deepest lineage. After log2(assets) rounds whatever is open is cyclic. An id that
    a case holds more than once has one level, by its last row; custody reports the repetition.
    """
    order = F.struct("position", "source_asset_id") if "position" in evidence.columns else F.struct("source_asset_id")
    once = evidence.groupBy("case_id", "asset_id").agg(F.max_by("source_asset_id", order).alias("source_asset_id"))
    parent = once.select("case_id", F.col("asset_id").alias("_p"), F.lit(True).alias("_in"))
    start = once.select("case_id", "asset_id", F.col("source_asset_id").alias("_p")).join(
        parent, ["case_id", "_p"], "left").select(
        "case_id", "asset_id", F.when(F.col("_in"), F.col("_p")).alias("up"),
        F.when(F.col("_in"), 1).otherwise(0).cast("long").alias("depth"))
    current, seen = store(start, n=F.count(F.lit(1)), open=F.count("up"))
    for _ in range(math.ceil(math.log2(max(seen["n"], 1))) + 1):
        if not seen["open"]:
            break
        above = current.select("case_id", F.col("asset_id").alias("up"), F.col("up").alias("_up2"), F.col("depth").alias("_d2"))
        stepped = current.join(above, ["case_id", "up"], "left").select(
            "case_id", "asset_id", F.col("_up2").alias("up"), (F.col("depth") + F.coalesce("_d2", F.lit(0))).alias("depth"))
        current, seen = store(stepped, n=F.count(F.lit(1)), open=F.count("up"))
    cyclic = F.col("up").isNotNull()
    return current.select("case_id", "asset_id", F.when(~cyclic, F.col("depth")).alias("level"), cyclic.alias("in_cycle"))


# ---------------------------------------------------------------- listing and checks

def filter_cases(cases: DataFrame, **filters) -> DataFrame:
    """Filters by column name: a value, or a list of which one must fit; created_from and created_until. None is ignored."""
    out = cases
    for name, value in filters.items():
        if value is None:
            continue
        if name == "created_from":
            out = out.where(F.col("created_at") >= F.lit(value).cast("timestamp"))
        elif name == "created_until":
            out = out.where(F.col("created_at") <= F.lit(value).cast("timestamp"))
        elif isinstance(value, (list, tuple, set)):
            out = out.where(F.col(name).isin(list(value)))
        else:
            out = out.where(F.col(name) == value)
    return out


def list_cases(cases: DataFrame, offset: int = 0, limit: int = 25, **filters) -> tuple[DataFrame, DataFrame]:
    """(page ordered by score descending and id, one-row total). The page size is at most 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    chosen = filter_cases(cases, **filters)
    page = chosen.orderBy(F.desc("score"), F.asc("case_id")).offset(offset).limit(limit)
    return page, chosen.agg(F.count("*").alias("total"))


def classify_failures(errors: DataFrame, kind: str = "error_kind") -> DataFrame:
    """Failure code and whether a retry can help."""
    code, transient = F.lit(K.FAILURE_DEFAULT[0]), F.lit(K.FAILURE_DEFAULT[1])
    for name, (value, again) in K.FAILURE_CODES.items():
        code = F.when(F.col(kind) == name, value).otherwise(code)
        transient = F.when(F.col(kind) == name, again).otherwise(transient)
    return errors.withColumn("failure_code", code).withColumn("transient", F.coalesce(transient, F.lit(False)))


MODEL_FIELDS = (
    "model_name", "model_version", "artifact_schema_version", "training_dataset_version", "feature_schema_version",
    "input_schema", "normalization", "class_mapping", "required_crs", "supported_resolution_m",
)


def model_mismatches(requests: DataFrame, models: DataFrame, fields: tuple[str, ...] = MODEL_FIELDS) -> DataFrame:
    """Fields in which a requested model differs from the stored one, then CRS and resolution.

    ``requests``: request_id, artifact_id, wanted fields, source_crs, source_resolution_m;
    ``models``: artifact_id and the same fields. required_crs is an array, supported_resolution_m
    an array of two numbers.
    """
    stored = models.select("artifact_id", *[F.col(f).alias(f"_m_{f}") for f in fields], F.lit(True).alias("_known"))
    joined = requests.join(stored, "artifact_id", "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_m_{f}")), F.lit(f)) for f in fields]))
    error = F.when(F.col("_known").isNull(), "MODEL_NOT_AVAILABLE").when(F.size(wrong) > 0, "MODEL_SCHEMA_MISMATCH")
    if "required_crs" in fields:
        error = F.coalesce(error, F.when(
            (F.size("required_crs") > 0) & ~F.array_contains("required_crs", F.col("source_crs")), "CRS_NOT_SUPPORTED"))
    if "supported_resolution_m" in fields:
        low, high = F.get("supported_resolution_m", F.lit(0)), F.get("supported_resolution_m", F.lit(1))
        error = F.coalesce(error, F.when(~F.col("source_resolution_m").between(low, high), "RESOLUTION_NOT_SUPPORTED"))
    return joined.select(*requests.columns, F.when(F.col("_known"), wrong).alias("mismatches"), error.alias("error_code"))
