"""Registered queries on changes, permits, rules, complaints and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.functions import boxes as G
from landshift.functions.scalars import request_key, round6, uuid5_url
from landshift.operators import complaints as C, outlines as U, risk as R, spatial as S, temporal as T
from landshift.plans import oracle as O
from landshift.plans.assess import assess_changes, grouped_complaints
from landshift.session import COMPACT, configured, cut_lineage, discard
from landshift.sources import bindings as B

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


def flag(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


# ---------------------------------------------------------------- permits and rules

PERMIT_STEPS = {
    "stats": "SELECT parcel_id, min(valid_until) AS first_end, count(*) AS n FROM permits GROUP BY 1",
    "asked": "SELECT DISTINCT parcel_id, plan_version, capture_date FROM {src}",
    "hits": """SELECT a.parcel_id, a.plan_version, a.capture_date, p.permit_id, p.valid_from,
        p.plan_version = a.plan_version AS same_plan,
        row_number() OVER (PARTITION BY a.parcel_id, a.plan_version, a.capture_date
          ORDER BY (p.plan_version = a.plan_version) DESC, p.valid_from DESC, p.permit_id DESC) AS k
        FROM asked a JOIN permits p ON p.parcel_id = a.parcel_id
          AND p.valid_from <= a.capture_date AND a.capture_date <= p.valid_until""",
    "decided": """SELECT a.parcel_id, a.plan_version, a.capture_date,
        CASE WHEN s.n IS NULL THEN 'no_match' WHEN h.same_plan THEN 'valid_match'
             WHEN h.permit_id IS NOT NULL THEN 'wrong_plan_version'
             WHEN s.first_end < a.capture_date THEN 'expired_at_capture' ELSE 'not_yet_valid' END AS permit_status,
        CASE WHEN h.same_plan THEN h.permit_id END AS matched_permit_id, coalesce(s.n, 0) AS candidate_count
        FROM asked a LEFT JOIN stats s ON s.parcel_id = a.parcel_id
        LEFT JOIN (SELECT * FROM hits WHERE k = 1) h ON h.parcel_id = a.parcel_id
          AND h.plan_version = a.plan_version AND h.capture_date = a.capture_date""",
}


def permit_steps(src: str) -> dict[str, str]:
    return {k: v.replace("{src}", src) for k, v in PERMIT_STEPS.items()}


@query("permit_at_capture", O.sql(
    """SELECT c.change_id, d.permit_status, coalesce(d.matched_permit_id, '') AS matched_permit_id,
       CAST(d.candidate_count AS BIGINT) AS candidate_count
       FROM changes c JOIN decided d ON d.parcel_id = c.parcel_id AND d.plan_version = c.plan_version
         AND d.capture_date = c.capture_date""",
    "changes", "permits", extra=permit_steps("changes")))
def permit_at_capture(spark: SparkSession, root: str) -> DataFrame:
    found = T.permit_at_capture(B.changes(spark, root), B.permits(spark, root))
    return found.select(
        "change_id", "permit_status", F.coalesce("matched_permit_id", F.lit("")).alias("matched_permit_id"),
        "candidate_count",
    )


@query("permit_candidates", O.sql(
    """SELECT parcel_id, permit_id, CAST(plan_version AS BIGINT) AS plan_version FROM permits
       WHERE parcel_id IN (SELECT parcel_id FROM changes)""", "changes", "permits"))
def permit_candidates(spark: SparkSession, root: str) -> DataFrame:
    found = T.permit_candidates(B.changes(spark, root), B.permits(spark, root))
    return found.select("parcel_id", "permit_id", F.col("plan_version").cast("long").alias("plan_version"))


RULE_STEPS = {
    "rule_asked": "SELECT DISTINCT municipality_id, zone, capture_date FROM placed WHERE municipality_id IS NOT NULL",
    "rule_found": """SELECT a.*, r.rule_set_id, r.effective_from,
        rank() OVER (PARTITION BY a.municipality_id, a.zone, a.capture_date ORDER BY r.effective_from DESC) AS k
        FROM rule_asked a JOIN rule_sets r ON r.municipality_id = a.municipality_id AND r.zone = a.zone
          AND r.effective_from <= a.capture_date
          AND (r.effective_until IS NULL OR a.capture_date <= r.effective_until)""",
    "rule_best": """SELECT municipality_id, zone, capture_date, count(*) AS n, min(rule_set_id) AS rule_set_id
        FROM rule_found WHERE k = 1 GROUP BY 1, 2, 3""",
    "rule_decided": """SELECT a.*, CASE WHEN b.n = 1 THEN b.rule_set_id END AS rule_set_id,
        CASE WHEN b.n IS NULL THEN 'NO_EFFECTIVE_RULE_SET' WHEN b.n > 1 THEN 'AMBIGUOUS_RULE_SETS' END AS rule_error
        FROM rule_asked a LEFT JOIN rule_best b ON b.municipality_id = a.municipality_id AND b.zone = a.zone
          AND b.capture_date = a.capture_date""",
}


@query("rule_in_force", O.sql(
    """SELECT p.change_id, coalesce(d.rule_set_id, '') AS rule_set_id, coalesce(d.rule_error, '') AS rule_error
       FROM placed p JOIN rule_decided d ON d.municipality_id = p.municipality_id AND d.zone = p.zone
         AND d.capture_date = p.capture_date""",
    "changes", "parcels", "rule_sets",
    extra={"placed": """SELECT c.change_id, c.capture_date, p.municipality_id, p.zone FROM changes c
           JOIN parcels p ON p.parcel_id = c.parcel_id""", **RULE_STEPS}))
def rule_in_force(spark: SparkSession, root: str) -> DataFrame:
    placed = B.changes(spark, root).select("change_id", "parcel_id", "capture_date").join(
        B.parcels(spark, root).select("parcel_id", "municipality_id", "zone"), "parcel_id")
    rules = T.rule_in_force(placed, B.rule_sets(spark, root))
    return placed.join(rules, ["municipality_id", "zone", "capture_date"]).select(
        "change_id", F.coalesce("rule_set_id", F.lit("")).alias("rule_set_id"),
        F.coalesce("rule_error", F.lit("")).alias("rule_error"))


@query("rule_compatibility", O.sql(
    """SELECT q.change_id, q.asked_id, CASE WHEN r.rule_set_id IS NULL THEN 'RULE_SET_NOT_AVAILABLE'
         WHEN NOT (r.municipality_id = q.municipality_id AND r.zone = q.zone AND r.effective_from <= q.capture_date
           AND (r.effective_until IS NULL OR q.capture_date <= r.effective_until)) THEN 'RULE_SET_INCOMPATIBLE'
         ELSE '' END AS error_code
       FROM asked_rules q LEFT JOIN rule_sets r ON r.rule_set_id = q.asked_id""",
    "changes", "parcels", "rule_sets",
    extra={"asked_rules": """SELECT c.change_id, c.capture_date, p.municipality_id, p.zone,
           'rules-' || substr(p.municipality_id, 5) || '-' || substr(p.zone, 6) || '-'
             || CAST(extract(year FROM c.capture_date) AS INTEGER) || '-' || (c.age_days % 20) // 19 AS asked_id
           FROM changes c JOIN parcels p ON p.parcel_id = c.parcel_id"""}))
def rule_compatibility(spark: SparkSession, root: str) -> DataFrame:
    age = T.evidence_age_days(F.col("capture_time"), F.col("evaluation_time"))
    asked = B.changes(spark, root).join(
        B.parcels(spark, root).select("parcel_id", "municipality_id", "zone"), "parcel_id"
    ).select(
        "change_id", "capture_date", "municipality_id", "zone",
        F.lit("1.0.0").alias("rule_version"), F.lit("1.0.0").alias("risk_threshold_version"),
        F.concat_ws("-", F.lit("rules"), F.expr("substr(municipality_id, 5)"), F.expr("substr(zone, 6)"),
                    F.year("capture_date").cast("string"),
                    F.floor(age % 20 / 19).cast("string")).alias("rule_set_id"),
    )
    return T.rule_compatibility(asked, B.rule_sets(spark, root)).select(
        "change_id", F.col("rule_set_id").alias("asked_id"), F.coalesce("error_code", F.lit("")).alias("error_code"))


_CASE_ID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)
    FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('{p}:' || {k} AS BLOB)) AS h))"""


def uuid_sql(prefix: str, key: str) -> str:
    return _CASE_ID.replace("{p}", prefix).replace("{k}", key)


@query("image_pairs", O.sql(
    f"""SELECT old_asset_id, new_asset_id, {uuid_sql('image-pair', "old_asset_id || ':' || new_asset_id || ':' || old_sha || ':' || new_sha")} AS image_pair_id FROM (
         SELECT p.old.id AS old_asset_id, a.asset_id AS new_asset_id, p.old.sha AS old_sha, a.content_sha256 AS new_sha FROM assets a JOIN (
           SELECT municipality_id, ax0, ax1, capture_time, lag(least) OVER (PARTITION BY municipality_id, ax0, ax1 ORDER BY capture_time) AS old
           FROM (SELECT municipality_id, ax0, ax1, capture_time, arg_min({{'id': asset_id, 'sha': content_sha256}}, asset_id) AS least
                 FROM assets GROUP BY ALL)) p USING (municipality_id, ax0, ax1, capture_time) WHERE p.old IS NOT NULL)""", "assets"))
def image_pairs(spark: SparkSession, root: str) -> DataFrame:
    return T.image_pairs(B.assets(spark, root), ["municipality_id", "box"]).select("old_asset_id", "new_asset_id", "image_pair_id")


@query("image_pair_check", O.sql(
    """SELECT o.asset_id AS old_asset_id, 'asset-' || o.ordinal * 3 AS new_asset_id,
         CASE WHEN n.asset_id IS NULL THEN 'ASSET_NOT_FOUND' WHEN o.municipality_id <> n.municipality_id
           THEN 'MUNICIPALITY_MISMATCH' WHEN o.capture_time >= n.capture_time THEN 'CAPTURE_ORDER' ELSE '' END AS error_code
       FROM assets o LEFT JOIN assets n ON n.asset_id = 'asset-' || o.ordinal * 3""", "assets"))
def image_pair_check(spark: SparkSession, root: str) -> DataFrame:
    assets = B.assets(spark, root)
    asked = assets.select(F.col("asset_id").alias("old_asset_id"),
                          F.concat(F.lit("asset-"), (F.col("ordinal") * 3).cast("string")).alias("new_asset_id"))
    return T.pair_check(asked, assets).select(
        "old_asset_id", "new_asset_id", F.coalesce("error_code", F.lit("")).alias("error_code"))


@query("evidence_age", O.sql(
    """SELECT change_id, CAST(age_days AS BIGINT) AS age_days, CAST(age_days > 180 AS INTEGER) AS stale
       FROM changes""", "changes"))
def evidence_age(spark: SparkSession, root: str) -> DataFrame:
    age = T.evidence_age_days(F.col("capture_time"), F.col("evaluation_time"))
    return B.changes(spark, root).select(
        "change_id", age.cast("long").alias("age_days"), flag(age > 180).alias("stale"))


def _keyed(spark: SparkSession, root: str) -> DataFrame:
    q = B.requests(spark, root)
    return q.withColumn("request_key", request_key(
        F.col("source_hashes"), F.col("image_pair_id"), F.col("config_hash"), F.col("model_version"),
        F.col("rule_set_version"), F.col("operation")))


REQUESTS_SQL = """SELECT event_id AS request_id, ts, sha256('{"image_pair_id":"pair-' || user_id || '","model_version":"'
    || event_type || '","operation_type":"process_pair","processing_configuration_hash":"' || sha256(props)
    || '","rule_set_version":"1.0.0","source_asset_hashes":["' || sha256('old-' || user_id) || '","'
    || sha256('new-' || user_id) || '"]}') AS request_key FROM events"""


@query("request_keys", "SELECT request_id, request_key FROM (" + REQUESTS_SQL + ")")
def request_keys(spark: SparkSession, root: str) -> DataFrame:
    return _keyed(spark, root).select("request_id", "request_key")


@query("new_requests", f"""WITH q AS ({REQUESTS_SQL}),
    seen AS (SELECT DISTINCT request_key FROM q WHERE ts < TIMESTAMP '2024-01-10'),
    later AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ts) AS k FROM q
              WHERE ts >= TIMESTAMP '2024-01-10')
    SELECT request_key, request_id FROM later WHERE k = 1 AND request_key NOT IN (SELECT request_key FROM seen)""")
def new_requests(spark: SparkSession, root: str) -> DataFrame:
    keyed = _keyed(spark, root).select("request_id", "request_key", "ts")
    cut = F.lit("2024-01-10").cast("timestamp")
    return T.new_requests(keyed.where(F.col("ts") >= cut), keyed.where(F.col("ts") < cut)).select(
        "request_key", "request_id")


# ---------------------------------------------------------------- spatial

OVERLAPS = f"""SELECT c.change_id, p.parcel_id, {O.inter('c', 'p')} AS overlap_area,
    least(100e0, 100 * {O.inter('c', 'p')} / {O.inter('c')}) AS overlap_percent,
    p.px0 <= c.cx0 AND p.py0 <= c.cy0 AND p.px1 >= c.cx1 AND p.py1 >= c.cy1 AS covered
    FROM changes c JOIN parcels p ON p.px0 < c.cx1 AND c.cx0 < p.px1 AND p.py0 < c.cy1 AND c.cy0 < p.py1
    WHERE {O.inter('c', 'p')} > 1e-9"""
MATCH = """SELECT c.change_id, b.parcel_id AS matched_parcel_id, coalesce(b.overlap_area, 0e0) AS match_area,
    coalesce(b.overlap_percent, 0e0) AS match_percent, coalesce(NOT b.covered, false) AS boundary_crossing,
    coalesce(b.n, 0) AS overlap_count
    FROM changes c LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY change_id) AS n,
      row_number() OVER (PARTITION BY change_id ORDER BY overlap_area DESC, parcel_id) AS k FROM parcel_hits) b
      ON b.change_id = c.change_id AND b.k = 1"""


@query("parcel_overlaps", O.sql(
    f"""SELECT change_id, parcel_id, {O.r6('overlap_area')} AS overlap_area,
        {O.r6('overlap_percent')} AS overlap_percent, CAST(covered AS INTEGER) AS covered FROM parcel_hits""",
    "changes", "parcels", extra={"parcel_hits": OVERLAPS}))
def parcel_overlaps(spark: SparkSession, root: str) -> DataFrame:
    found = S.parcel_overlaps(B.changes(spark, root), B.parcels(spark, root))
    return found.select("change_id", "parcel_id", round6(F.col("overlap_area")).alias("overlap_area"),
                        round6(F.col("overlap_percent")).alias("overlap_percent"), flag("covered").alias("covered"))


@query("parcel_match", O.sql(
    f"""SELECT change_id, coalesce(matched_parcel_id, '') AS parcel_id, {O.r6('match_area')} AS match_area,
        {O.r6('match_percent')} AS match_percent, CAST(boundary_crossing AS INTEGER) AS boundary_crossing,
        CAST(overlap_count > 1 AS INTEGER) AS ambiguous, CAST(overlap_count = 0 AS INTEGER) AS no_match,
        CAST(overlap_count AS BIGINT) AS overlap_count FROM matched""",
    "changes", "parcels", extra={"parcel_hits": OVERLAPS, "matched": MATCH}))
def parcel_match(spark: SparkSession, root: str) -> DataFrame:
    changes = B.changes(spark, root)
    m = S.parcel_match(S.parcel_overlaps(changes, B.parcels(spark, root)), changes)
    return m.select(
        "change_id", F.coalesce("matched_parcel_id", F.lit("")).alias("parcel_id"),
        round6(F.col("match_area")).alias("match_area"), round6(F.col("match_percent")).alias("match_percent"),
        flag("boundary_crossing").alias("boundary_crossing"), flag("multiple_parcel_ambiguity").alias("ambiguous"),
        flag("no_parcel_match").alias("no_match"), F.col("overlap_count"))


FIRST_PLAN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ordinal) AS k FROM footprints) WHERE k = 1"
_INNER = "greatest(least(nx1, px1 - {s}) - greatest(nx0, px0 + {s}), 0e0) * greatest(least(ny1, py1 - {s}) - greatest(ny0, py0 + {s}), 0e0)"


def plan_area_sql(setback: str) -> dict[str, str]:
    inner = _INNER.replace("{s}", setback)
    return {
        "approved_area": O.inter("f"), "old_area": O.inter("o"), "new_area": O.inter("n"),
        "added_area": f"{O.inter('n')} - {O.inter('n', 'o')}",
        "added_outside_approval_area": f"{O.inter('n')} - {O.inter('n', 'o')} - {O.inter('n', 'f')} + {O.inter('n', 'o', 'f')}",
        "removed_approved_area": f"{O.inter('f', 'o')} - {O.inter('f', 'o', 'n')}",
        "setback_zone_area": f"CASE WHEN {setback} = 0 THEN 0e0 ELSE {O.inter('n', 'p')} - ({inner}) END",
        "site_coverage_ratio": f"{O.inter('n', 'p')} / {O.inter('p')}",
    }


@query("plan_comparison", O.sql(
    "SELECT change_id, " + ", ".join(f"{O.r6(e)} AS {n}" for n, e in plan_area_sql("5e0").items())
    + " FROM changes c JOIN parcels p ON p.parcel_id = c.parcel_id JOIN first_plan f ON f.parcel_id = c.parcel_id",
    "changes", "parcels", "footprints", extra={"first_plan": FIRST_PLAN}))
def plan_comparison(spark: SparkSession, root: str) -> DataFrame:
    from landshift.plans.assess import first_footprints

    areas = S.plan_areas(F.col("approved_box"), F.col("old_box"), F.col("new_box"), F.col("parcel_box"), F.col("setback_m"))
    place = B.parcels(spark, root).select("parcel_id", "setback_m", F.col("box").alias("parcel_box")).join(
        first_footprints(B.approved_footprints(spark, root)), "parcel_id")
    return B.changes(spark, root).join(place, "parcel_id").select(
        "change_id", *[round6(e).alias(n) for n, e in areas.items()])


@query("plan_comparison_cells", O.sql(
    f"""SELECT c.footprint_id, {O.r6(O.inter('f'))} AS approved_area, {O.r6(O.inter('b'))} AS old_area,
        {O.r6(O.inter('g'))} AS new_area,
        {O.r6(O.inter('g') + ' - ' + O.inter('g', 'b'))} AS added_area,
        {O.r6(O.inter('g') + ' - ' + O.inter('g', 'b') + ' - ' + O.inter('g', 'f') + ' + ' + O.inter('g', 'b', 'f'))}
          AS added_outside_approval_area,
        {O.r6(O.inter('f', 'b') + ' - ' + O.inter('f', 'b', 'g'))} AS removed_approved_area
        FROM shapes c""",
    "footprints", extra={"shapes": """SELECT footprint_id, fx0, fy0, fx1, fy1, fx0 + 2 AS bx0, fy0 AS by0, fx1 - 6 AS bx1, fy1 AS by1,
        fx0 + 1 AS gx0, fy0 + 3 AS gy0, fx1 + 4 AS gx1, fy1 AS gy1 FROM footprints"""}))
def plan_comparison_cells(spark: SparkSession, root: str) -> DataFrame:
    b = F.col("box")
    shapes = B.approved_footprints(spark, root).select(
        "footprint_id", F.explode(F.array(
            F.struct(F.lit("approved").alias("src"), b.alias("shape")),
            F.struct(F.lit("old").alias("src"),
                     G.box(b["min_x"] + 2, b["min_y"], b["max_x"] - 6, b["max_y"]).alias("shape")),
            F.struct(F.lit("new").alias("src"),
                     G.box(b["min_x"] + 1, b["min_y"] + 3, b["max_x"] + 4, b["max_y"]).alias("shape")),
        )).alias("s")).select("footprint_id", "s.src", "s.shape")
    cells = S.box_cells(shapes, "shape", 1.0, ["footprint_id"])
    return S.plan_comparison_cells(cells, ["footprint_id"], 1.0).select(
        "footprint_id", *[round6(F.col(n)).alias(n) for n in (
            "approved_area", "old_area", "new_area", "added_area", "added_outside_approval_area",
            "removed_approved_area")])


#: Corners of the slanted shapes that the outline query compares, as offsets from a footprint's sides.
_SLANTED = {
    "old": ((1.25, 2.75), (-6.25, 0.75), (-3.75, -2.25), (2.75, -1.5)),
    "new": ((-3.25, 2.75), (2.25, -3.5), (4.75, -1.25), (1.75, 3.25)),
}


def _slanted_sql(name: str) -> str:
    """Whether a cell's centre lies left of all four sides of the shape, which turns to the left."""
    at = [(f"({'fx0' if i in (0, 3) else 'fx1'} + {dx})", f"({'fy0' if i < 2 else 'fy1'} + {dy})") for i, (dx, dy) in enumerate(_SLANTED[name])]
    return " AND ".join(
        f"({bx} - {ax}) * (cy + 0.5 - {ay}) - ({by} - {ay}) * (cx + 0.5 - {ax}) > 0" for (ax, ay), (bx, by) in zip(at, at[1:] + at[:1]))


@query("plan_comparison_outlines", O.sql(
    f"""SELECT footprint_id, {O.r6('count(*) FILTER (a)')} AS approved_area, {O.r6('count(*) FILTER (o)')} AS old_area,
        {O.r6('count(*) FILTER (n)')} AS new_area, {O.r6('count(*) FILTER (n AND NOT o)')} AS added_area,
        {O.r6('count(*) FILTER (n AND NOT o AND NOT a)')} AS added_outside_approval_area,
        {O.r6('count(*) FILTER (a AND o AND NOT n)')} AS removed_approved_area,
        {O.r6('count(*) FILTER (n AND p AND NOT i)')} AS setback_zone_area,
        {O.r6('count(*) FILTER (n AND p) / ((px1 - px0) * (py1 - py0))')} AS site_coverage_ratio
        FROM (SELECT *, cx + 0.5 > fx0 AND cx + 0.5 < fx1 AND cy + 0.5 > fy0 AND cy + 0.5 < fy1 AS a,
            cx + 0.5 > px0 AND cx + 0.5 < px1 AND cy + 0.5 > py0 AND cy + 0.5 < py1 AS p,
            cx + 0.5 > px0 + 5 AND cx + 0.5 < px1 - 5 AND cy + 0.5 > py0 + 5 AND cy + 0.5 < py1 - 5 AS i,
            {_slanted_sql('old')} AS o, {_slanted_sql('new')} AS n
          FROM (SELECT *, unnest(range(CAST(floor(fy0) AS BIGINT) - 5, CAST(floor(fy1) AS BIGINT) + 6)) AS cy
            FROM (SELECT f.footprint_id, fx0, fy0, fx1, fy1, px0, py0, px1, py1,
                unnest(range(CAST(floor(fx0) AS BIGINT) - 5, CAST(floor(fx1) AS BIGINT) + 6)) AS cx
              FROM footprints f JOIN parcels p ON p.parcel_id = f.parcel_id))) GROUP BY footprint_id, px0, py0, px1, py1""",
    "footprints", "parcels"))
def plan_comparison_outlines(spark: SparkSession, root: str) -> DataFrame:
    """Slanted old and new outlines of every footprint against its plan and its parcel."""
    f, p = F.col("f"), F.col("p")

    def ring(box: Column, offsets: tuple = ((0, 0),) * 4) -> Column:
        side = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")]
        at = [F.struct((box[x] + dx).cast("double").alias("x"), (box[y] + dy).cast("double").alias("y")) for (x, y), (dx, dy) in zip(side, offsets)]
        return F.array(*at, at[0])

    rows = B.approved_footprints(spark, root).select("footprint_id", "parcel_id", F.col("box").alias("f")).join(
        B.parcels(spark, root).select("parcel_id", "setback_m", F.col("box").alias("p")), "parcel_id")
    rings = {"approved": ring(f), "parcel": ring(p), **{s: ring(f, _SLANTED[s]) for s in _SLANTED}}
    shapes = rows.select("footprint_id", "setback_m", F.explode(F.array(*[
        F.struct(F.lit(s).alias("src"), r.alias("ring")) for s, r in rings.items()])).alias("s")).select("footprint_id", "setback_m", "s.src", "s.ring")
    found = U.plan_comparison_outlines(shapes, ["footprint_id"], 1.0)
    return found.select("footprint_id", *[round6(F.col(c)).alias(c) for c in found.columns if c not in ("footprint_id", "cell_m")])


HITS = """SELECT c.change_id, b.boundary_id FROM changes c JOIN boundaries b
    ON b.bx >= c.nx0 AND b.bx <= c.nx1 AND b.by0 <= c.ny1 AND b.by1 >= c.ny0"""


@query("boundary_hits", O.sql(HITS, "changes", "boundaries"))
def boundary_hits(spark: SparkSession, root: str) -> DataFrame:
    return S.boundary_hits(B.changes(spark, root), B.public_boundaries(spark, root), "change_id", "new_box")


@query("dissolved_area", O.sql(
    f"""SELECT parcel_id, {O.r6('count(*)')} AS union_area FROM (
        SELECT DISTINCT parcel_id, unnest(generate_series(CAST(fx0 AS BIGINT), CAST(fx1 AS BIGINT) - 1)) AS cx, cy FROM (
          SELECT parcel_id, fx0, fx1, unnest(generate_series(CAST(fy0 AS BIGINT), CAST(fy1 AS BIGINT) - 1)) AS cy
          FROM footprints)) GROUP BY 1""", "footprints"))
def dissolved_area(spark: SparkSession, root: str) -> DataFrame:
    cells = S.dissolve(S.box_cells(B.approved_footprints(spark, root).select("parcel_id", "box"), "box", 1.0, ["parcel_id"]), ["parcel_id"])
    return cells.groupBy("parcel_id").agg(round6(F.sum(F.col("cx_end") - F.col("cx")).cast("double")).alias("union_area"))


@query("box_scalars", O.sql(
    f"""SELECT c.change_id, {O.r6(O.inter('c'))} AS change_area, {O.r6(O.inter('o', 'n'))} AS kept_area,
        CAST({O.inter('c', 'n')} > 0 AS INTEGER) AS meets,
        {O.r6('CASE WHEN ' + O.inter('c', 'n') + ' > 0 THEN greatest(cx0, nx0) ELSE -1 END')} AS common_x,
        {O.r6('sqrt(pow(greatest(0e0, cx0 - nx1, nx0 - cx1), 2) + pow(greatest(0e0, cy0 - ny1, ny0 - cy1), 2))')} AS gap_m,
        {O.r6(O.inter('o', 'n') + ' / least(' + O.inter('o') + ', ' + O.inter('n') + ')')} AS overlap_ratio
        FROM changes c""", "changes"))
def box_scalars(spark: SparkSession, root: str) -> DataFrame:
    c, o, n = F.col("box"), F.col("old_box"), F.col("new_box")
    common = G.strict_overlap(c, n)
    return B.changes(spark, root).select(
        "change_id", round6(G.area(c)).alias("change_area"), round6(G.area(o, n)).alias("kept_area"),
        flag(common.isNotNull()).alias("meets"),
        round6(F.coalesce(common["min_x"], F.lit(-1.0))).alias("common_x"),
        round6(G.distance(c, n)).alias("gap_m"), round6(S.pair_overlap(o, n)).alias("overlap_ratio"))


# ---------------------------------------------------------------- complaints

COMPLAINT_STEPS = {
    "complaint_pairs": """SELECT l.parcel_id, l.complaint_id AS a, r.complaint_id AS b,
        l.description = r.description AS t, l.media_sha256 = r.media_sha256 AS m,
        4 * bit_count(xor(l.hash_code, r.hash_code)) <= 6 AS p
        FROM complaints l JOIN complaints r ON r.parcel_id = l.parcel_id AND l.ordinal < r.ordinal
        WHERE abs(epoch_us(l.received_at) - epoch_us(r.received_at)) <= 7 * 86400000000
          AND sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= 25
          AND (l.description = r.description OR l.media_sha256 = r.media_sha256
               OR 4 * bit_count(xor(l.hash_code, r.hash_code)) <= 6)""",
    "reach": """SELECT complaint_id AS v, complaint_id AS w FROM complaints
        UNION SELECT reach.v, CASE WHEN e.a = reach.w THEN e.b ELSE e.a END
        FROM reach JOIN complaint_pairs e ON e.a = reach.w OR e.b = reach.w""",
    "roots": "SELECT v AS complaint_id, min(w) AS group_root FROM reach GROUP BY v",
    "members": """SELECT c.*, r.group_root,
        row_number() OVER (PARTITION BY r.group_root ORDER BY c.received_at, c.complaint_id) AS k
        FROM complaints c JOIN roots r ON r.complaint_id = c.complaint_id""",
    "group_signals": """SELECT r.group_root, bool_or(t) AS t, bool_or(m) AS m, bool_or(p) AS p
        FROM complaint_pairs e JOIN roots r ON r.complaint_id = e.a GROUP BY 1""",
}


@query("complaint_groups", O.sql(
    """SELECT g.parcel_id, g.group_root, g.complaint_id AS representative_id, n.n AS members,
       'complaint-group-' || substr(sha256(n.ids), 1, 16) AS group_id,
       CASE WHEN s.group_root IS NULL THEN '' ELSE
         CASE WHEN m THEN 'MEDIA_HASH|' ELSE '' END || CASE WHEN p THEN 'PERCEPTUAL_HASH|' ELSE '' END
         || 'SAME_PARCEL|SPATIAL_PROXIMITY|' || CASE WHEN t THEN 'TEXT_SIMILARITY|' ELSE '' END || 'TIME_WINDOW' END AS signals
       FROM members g JOIN (SELECT group_root, count(*) AS n, string_agg(complaint_id, '|' ORDER BY k) AS ids
         FROM members GROUP BY 1) n ON n.group_root = g.group_root
       LEFT JOIN group_signals s ON s.group_root = g.group_root WHERE g.k = 1""",
    "complaints", extra=COMPLAINT_STEPS))
def complaint_groups(spark: SparkSession, root: str) -> DataFrame:
    membership, _links, groups = grouped_complaints(B.complaints(spark, root))
    ids = C.group_ids(membership)
    return groups.join(ids, "group_root").select(
        "parcel_id", "group_root", "representative_id", "members", "group_id",
        F.array_join("duplicate_signals", "|").alias("signals"))


@query("complaint_corroboration", O.sql(
    "SELECT parcel_id, count(*) AS complaint_groups FROM members WHERE k = 1 GROUP BY 1",
    "complaints", extra=COMPLAINT_STEPS))
def complaint_corroboration(spark: SparkSession, root: str) -> DataFrame:
    membership, _links, _groups = grouped_complaints(B.complaints(spark, root))
    return C.groups_per_parcel(membership)


# ---------------------------------------------------------------- risk

def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    membership, _links, _groups = grouped_complaints(B.complaints(spark, root))
    return {
        "changes": B.changes(spark, root), "parcels": B.parcels(spark, root),
        "approved_footprints": B.approved_footprints(spark, root), "permits": B.permits(spark, root),
        "rule_sets": B.rule_sets(spark, root), "public_boundaries": B.public_boundaries(spark, root),
        "complaint_counts": C.groups_per_parcel(membership),
    }


FACTORS_SQL = [
    ("CHANGE_CONFIDENCE", "change_confidence <> 0", O.r2("20e0 * change_confidence")),
    ("CHANGED_AREA", "changed_area <> 0", O.r2("10e0 * least(1e0, changed_area / 100e0)")),
    ("UNAPPROVED_ADDED_AREA", "added_outside_approval_area > 1e-9", "35e0"),
    ("WRONG_PLAN_VERSION", "permit_status = 'wrong_plan_version'", "15e0"),
    ("ACTIVE_PERMIT_NOT_FOUND", "permit_status NOT IN ('wrong_plan_version', 'valid_match')", "20e0"),
    ("PARCEL_BOUNDARY_REVIEW", "boundary_crossing OR overlap_count > 1", "15e0"),
    ("COMPLAINT_CORROBORATION", "complaint_groups > 0", "10e0"),
    ("SITE_COVERAGE_EXCEEDED", "site_coverage_ratio > maximum_site_coverage", "15e0"),
    ("SETBACK_ZONE_INTERSECTION", "setback_zone_area > 1e-9", "10e0"),
    ("PUBLIC_BOUNDARY_INTERSECTION", "boundary_hits > 0", "10e0"),
    ("REGISTRATION_QUALITY_PENALTY", "registration_quality < 0.8e0", "-10e0"),
    ("IMAGE_QUALITY_PENALTY", "warning_count > 0", "-5e0 * least(3, warning_count)"),
    ("STALE_EVIDENCE_PENALTY", "age_days > freshness", "-8e0"),
]

ASSESS_STEPS = {
    **COMPLAINT_STEPS,
    "complaint_counts": "SELECT parcel_id, count(*) AS complaint_groups FROM members WHERE k = 1 GROUP BY 1",
    "parcel_hits": OVERLAPS,
    "matched": MATCH,
    "first_plan": FIRST_PLAN,
    "placed": """SELECT c.*, m.matched_parcel_id, m.boundary_crossing, m.overlap_count, p.municipality_id, p.zone, p.ward_id,
        p.px0, p.py0, p.px1, p.py1, f.plan_version AS approved_version, f.fx0, f.fy0, f.fx1, f.fy1
        FROM changes c JOIN matched m ON m.change_id = c.change_id
        LEFT JOIN parcels p ON p.parcel_id = m.matched_parcel_id
        LEFT JOIN first_plan f ON f.parcel_id = m.matched_parcel_id""",
    "wanted": """SELECT DISTINCT matched_parcel_id AS parcel_id, approved_version AS plan_version, capture_date
        FROM placed WHERE matched_parcel_id IS NOT NULL""",
    **permit_steps("wanted"),
    **RULE_STEPS,
    "hit_counts": f"SELECT change_id, count(*) AS boundary_hits FROM ({HITS}) GROUP BY 1",
    "evidence": "SELECT p.*, " + ", ".join(f"{e} AS {n}" for n, e in plan_area_sql("r.setback_metres").items()) + f""",
        {O.inter('c')} AS changed_area, d.permit_status, rd.rule_error, r.rule_set_id, r.maximum_site_coverage, r.freshness,
        coalesce(k.complaint_groups, 0) AS complaint_groups, coalesce(h.boundary_hits, 0) AS boundary_hits
        FROM placed p
        LEFT JOIN rule_decided rd ON rd.municipality_id = p.municipality_id AND rd.zone = p.zone AND rd.capture_date = p.capture_date
        LEFT JOIN rule_sets r ON r.rule_set_id = rd.rule_set_id
        LEFT JOIN decided d ON d.parcel_id = p.matched_parcel_id AND d.plan_version = p.approved_version
          AND d.capture_date = p.capture_date
        LEFT JOIN complaint_counts k ON k.parcel_id = p.matched_parcel_id
        LEFT JOIN hit_counts h ON h.change_id = p.change_id""",
    "scored": "SELECT *, "
    + ", ".join(f"CASE WHEN {cond} THEN {pts} ELSE 0e0 END AS pt{i}" for i, (_c, cond, pts) in enumerate(FACTORS_SQL))
    + ", concat_ws('|', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond, _p in FACTORS_SQL)
    + """) AS factor_codes, CASE WHEN overlap_count = 0 THEN 'NO_PARCEL_MATCH'
        WHEN rule_error IS NOT NULL THEN rule_error ELSE '' END AS error_code FROM evidence""",
    "final": "SELECT *, " + O.r2("greatest(0e0, least(100e0, " + " + ".join(f"pt{i}" for i in range(13)) + "))")
    + " AS score FROM scored",
    "levelled": """SELECT *, CASE WHEN score >= 75 THEN 'CRITICAL_REVIEW' WHEN score >= 50 THEN 'HIGH'
        WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM final""",
}
ASSESS_TABLES = ("changes", "parcels", "footprints", "permits", "rule_sets", "boundaries", "complaints")


@query("assess_changes", O.sql(
    """SELECT change_id, coalesce(matched_parcel_id, '') AS parcel_id, error_code,
       CASE WHEN error_code = '' THEN score ELSE -1e0 END AS score,
       CASE WHEN error_code = '' THEN level ELSE '' END AS level,
       CASE WHEN error_code = '' THEN factor_codes ELSE '' END AS factor_codes FROM levelled""",
    *ASSESS_TABLES, extra=ASSESS_STEPS))
def assess_changes_query(spark: SparkSession, root: str) -> DataFrame:
    done = assess_changes(_tables(spark, root))
    scored = F.col("error_code").isNull()
    return done.select(
        "change_id", F.coalesce("parcel_id", F.lit("")).alias("parcel_id"),
        F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("score", F.lit(-1.0)).alias("score"),
        F.coalesce("level", F.lit("")).alias("level"),
        F.when(scored, F.array_join(F.transform("factors", lambda f: f["code"]), "|")).otherwise("").alias("factor_codes"))


@query("risk_factors", O.sql(
    "SELECT change_id, code, points FROM ("
    + " UNION ALL ".join(f"SELECT change_id, '{code}' AS code, pt{i} AS points FROM levelled WHERE error_code = '' AND ({cond})"
                         for i, (code, cond, _p) in enumerate(FACTORS_SQL)) + ")",
    *ASSESS_TABLES, extra=ASSESS_STEPS))
def risk_factors(spark: SparkSession, root: str) -> DataFrame:
    done = assess_changes(_tables(spark, root)).where(F.col("error_code").isNull())
    return R.risk_factors(done, "change_id").select("change_id", "code", "points")


@query("risk_levels", O.sql(
    f"""SELECT coalesce(level, '*') AS level, coalesce(ward_id, '*') AS ward_id, count(*) AS cases,
        {O.r2('sum(score)')} AS score_sum FROM levelled WHERE error_code = '' GROUP BY CUBE (level, ward_id)""",
    *ASSESS_TABLES, extra=ASSESS_STEPS))
def risk_levels(spark: SparkSession, root: str) -> DataFrame:
    done = assess_changes(_tables(spark, root)).where(F.col("error_code").isNull())
    from landshift.functions.scalars import round2

    return R.level_distribution(done, ["ward_id"]).select(
        F.coalesce("level", F.lit("*")).alias("level"), F.coalesce("ward_id", F.lit("*")).alias("ward_id"),
        "cases", round2(F.col("score_sum")).alias("score_sum"))


@query("review_queue", O.sql(
    f"""SELECT 'review-' || substr(sha256(case_id || ':' || rule_set_id), 1, 20) AS queue_item_id, case_id, risk_score,
        risk_level, row_number() OVER (ORDER BY risk_score DESC, case_id) AS queue_rank FROM (
        SELECT {uuid_sql('inspection-case', 'change_id')} AS case_id, rule_set_id, score AS risk_score, level AS risk_level
        FROM levelled WHERE error_code = '')""",
    *ASSESS_TABLES, extra=ASSESS_STEPS))
def review_queue(spark: SparkSession, root: str) -> DataFrame:
    from landshift.operators.ranking import global_rank

    done = assess_changes(_tables(spark, root)).where(F.col("error_code").isNull())
    # Stored: the shuffles of the assessment are gone before that of the order, and the scores are not made again for its ranges.
    with configured(spark, *COMPACT):
        queue = cut_lineage(R.review_queue(done).select("queue_item_id", "case_id", "risk_score", "risk_level"))
        ranked = global_rank(queue, [F.col("risk_score").desc(), F.col("case_id").asc()], "queue_rank")
    discard(queue)
    return ranked


@query("deterministic_ids", f"""SELECT o_orderkey, {uuid_sql('permit', "o_orderkey || ':' || o_custkey")} AS permit_uuid FROM orders""")
def deterministic_ids(spark: SparkSession, root: str) -> DataFrame:
    return B.table(spark, root, "orders").select(
        "o_orderkey", uuid5_url("permit", F.col("o_orderkey"), F.col("o_custkey")).alias("permit_uuid"))
