"""Registered queries on validation, quarantine, publishing and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landshift.functions import boxes as G
from landshift.functions.metadata import has_sensitive_key, safe_metadata_json, uri_has_secrets
from landshift.functions.scalars import round6
from landshift.operators import rings as R, spatial as S, validate as V
from landshift.plans import oracle as O
from landshift.plans.risk_queries import flag
from landshift.session import scratch_path
from landshift.sources import bindings as B, catalogue as K
from landshift.sources.publish import BundleStore

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


AT = f"TIMESTAMP '{B.REFERENCE_TIME}'"
_EXTENT = "min(px0) AS {p}x0, min(py0) AS {p}y0, max(px1) AS {p}x1, max(py1) AS {p}y1"

FAULTS = {
    "mun_ext": "SELECT municipality_id, " + _EXTENT.replace("{p}", "m") + " FROM parcels GROUP BY 1",
    "ward_ext": "SELECT ward_id, " + _EXTENT.replace("{p}", "w") + " FROM parcels GROUP BY 1",
    "q_mun": """SELECT municipality_id, mx0, my0, CASE WHEN municipality_id = 'mun-4' THEN mx0 - 1 ELSE mx1 END AS mx1, my1,
        CASE WHEN municipality_id = 'mun-4' THEN 'INVALID_GEOMETRY' END AS reason FROM mun_ext""",
    "raw_ward": """SELECT w.ward_id, 'mun-' || CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END AS municipality_id,
        wx0 - CASE WHEN n_nationkey = 9 THEN 1000 ELSE 0 END AS wx0, wy0,
        wx1 - CASE WHEN n_nationkey % 5 = 3 THEN 100 ELSE 0 END AS wx1, wy1,
        CASE WHEN n_nationkey = 11 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS crs
        FROM nation JOIN ward_ext w ON w.ward_id = 'ward-' || n_nationkey""",
    "q_ward": """SELECT w.*, CASE WHEN wx0 >= wx1 OR wy0 >= wy1 THEN 'INVALID_GEOMETRY'
        WHEN m.municipality_id IS NULL OR m.reason IS NOT NULL THEN 'MISSING_MUNICIPALITY'
        WHEN w.crs <> 'EPSG:32643' THEN 'CRS_MISMATCH'
        WHEN NOT (mx0 <= wx0 AND my0 <= wy0 AND mx1 >= wx1 AND my1 >= wy1) THEN 'OUTSIDE_MUNICIPALITY' END AS reason
        FROM raw_ward w LEFT JOIN q_mun m ON m.municipality_id = w.municipality_id""",
    "q_parcel": """SELECT p.*, CASE WHEN w.ward_id IS NULL OR w.reason IS NOT NULL THEN 'MISSING_WARD'
        WHEN w.crs <> 'EPSG:32643' THEN 'CRS_MISMATCH'
        WHEN NOT (wx0 <= px0 AND wy0 <= py0 AND wx1 >= px1 AND wy1 >= py1) THEN 'OUTSIDE_WARD' END AS reason
        FROM parcels p LEFT JOIN q_ward w ON w.ward_id = p.ward_id""",
    "raw_bld": """SELECT 'bld-' || c_custkey AS building_id, 'parcel-' || c_custkey AS parcel_id,
        'fp-' || CASE WHEN c_custkey % 17 = 0 THEN c_custkey + 1 ELSE c_custkey END AS footprint_id
        FROM customer WHERE c_custkey <> 13""",
    "fp_local": """SELECT f.*, CASE WHEN p.parcel_id IS NULL OR p.reason IS NOT NULL THEN 'MISSING_PARCEL'
        WHEN b.building_id IS NULL THEN 'MISSING_BUILDING'
        WHEN NOT (px0 + 5 <= fx0 AND py0 + 5 <= fy0 AND px1 - 5 >= fx1 AND py1 - 5 >= fy1) THEN 'BUILDING_OUTSIDE_PARCEL' END AS reason
        FROM footprints f LEFT JOIN q_parcel p ON p.parcel_id = f.parcel_id
        LEFT JOIN raw_bld b ON b.building_id = f.building_id""",
    "q_bld": """SELECT b.*, CASE WHEN p.parcel_id IS NULL OR p.reason IS NOT NULL THEN 'MISSING_PARCEL'
        WHEN f.footprint_id IS NULL OR f.reason IS NOT NULL OR f.building_id <> b.building_id OR f.parcel_id <> b.parcel_id
          THEN 'INVALID_FOOTPRINT_LINK' END AS reason
        FROM raw_bld b LEFT JOIN q_parcel p ON p.parcel_id = b.parcel_id
        LEFT JOIN fp_local f ON f.footprint_id = b.footprint_id""",
    "q_fp": """SELECT f.footprint_id, f.plan_version,
        coalesce(f.reason, CASE WHEN b.reason IS NOT NULL THEN 'MISSING_BUILDING' END) AS reason
        FROM fp_local f LEFT JOIN q_bld b ON b.building_id = f.building_id""",
    "raw_permit": f"""SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'active'
          WHEN u < DATE '1998-06-15' OR s > DATE '1998-06-15' THEN 'expired' ELSE 'active' END AS status FROM (
        SELECT o_orderkey, 'permit-' || o_orderkey AS permit_id, 'parcel-' || o_custkey AS parcel_id,
          'fp-' || o_custkey AS footprint_id,
          1 + (o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) % 2 AS plan_version,
          CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE)
            + CAST(CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE 30 + o_orderkey % 11 * 30 END AS INTEGER) AS u FROM orders)""",
    "q_permit": """SELECT t.permit_id, CASE WHEN s > u THEN 'INVALID_PERMIT_DATES'
        WHEN (status = 'active' AND NOT (DATE '1998-06-15' BETWEEN s AND u)) OR (status = 'expired' AND u >= DATE '1998-06-15')
          THEN 'PERMIT_STATUS_DATE_MISMATCH'
        WHEN p.parcel_id IS NULL OR p.reason IS NOT NULL THEN 'MISSING_PARCEL'
        WHEN f.footprint_id IS NULL OR f.reason IS NOT NULL OR f.plan_version <> t.plan_version THEN 'INVALID_PLAN_LINK' END AS reason
        FROM raw_permit t LEFT JOIN q_parcel p ON p.parcel_id = t.parcel_id LEFT JOIN q_fp f ON f.footprint_id = t.footprint_id""",
    "q_complaint": """SELECT c.complaint_id, CASE WHEN p.parcel_id IS NULL OR p.reason IS NOT NULL THEN 'MISSING_PARCEL'
        WHEN NOT (px0 <= x AND x <= px1 AND py0 <= y AND y <= py1) THEN 'OUTSIDE_PARCEL' END AS reason
        FROM complaints c LEFT JOIN q_parcel p ON p.parcel_id = c.parcel_id""",
    "q_asset": """SELECT asset_id, CASE WHEN capture_time > ingestion_time THEN 'INVALID_CAPTURE_TIME'
        WHEN box_crs <> 'EPSG:32643' THEN 'CRS_MISMATCH'
        WHEN row_number() OVER (PARTITION BY content_sha256 ORDER BY ordinal) > 1 THEN 'DUPLICATE_ASSET_HASH' END AS reason
        FROM assets""",
    "q_case": """SELECT 'seed-' || o_orderkey AS case_id, CASE WHEN p.parcel_id IS NULL OR p.reason IS NOT NULL
          OR b.building_id IS NULL OR b.reason IS NOT NULL OR t.permit_id IS NULL OR t.reason IS NOT NULL
          OR i.s_suppkey IS NULL OR a1.asset_id IS NULL OR a1.reason IS NOT NULL OR a2.asset_id IS NULL
          OR a2.reason IS NOT NULL OR (o_orderkey % 2 = 0 AND (k.complaint_id IS NULL OR k.reason IS NOT NULL))
          THEN 'INVALID_CASE_RELATIONSHIP' END AS reason
        FROM orders LEFT JOIN q_parcel p ON p.parcel_id = 'parcel-' || o_custkey
        LEFT JOIN q_bld b ON b.building_id = 'bld-' || o_custkey LEFT JOIN q_permit t ON t.permit_id = 'permit-' || o_orderkey
        LEFT JOIN supplier i ON i.s_suppkey = o_orderkey % 12
        LEFT JOIN q_asset a1 ON a1.asset_id = 'asset-' || o_orderkey % 150
        LEFT JOIN q_asset a2 ON a2.asset_id = 'asset-' || o_orderkey % 170
        LEFT JOIN q_complaint k ON k.complaint_id = 'complaint-' || o_orderkey % 900""",
    "judged": " UNION ALL ".join(
        f"SELECT '{entity}' AS entity, {key} AS id, reason FROM {src}" for entity, key, src in (
            ("municipalities", "municipality_id", "q_mun"), ("wards", "ward_id", "q_ward"),
            ("parcels", "parcel_id", "q_parcel"), ("approved_buildings", "building_id", "q_bld"),
            ("approved_footprints", "footprint_id", "q_fp"), ("permits", "permit_id", "q_permit"),
            ("imagery_assets", "asset_id", "q_asset"), ("complaints", "complaint_id", "q_complaint"),
            ("inspection_cases", "case_id", "q_case"),
        )) + """ UNION ALL SELECT 'inspectors', 'insp-' || s_suppkey, NULL FROM supplier
             UNION ALL SELECT 'public_boundaries', boundary_id, NULL FROM boundaries""",
}
FAULT_TABLES = ("parcels", "footprints", "complaints", "assets", "boundaries")


def _validated(spark: SparkSession, root: str):
    at = F.lit(B.REFERENCE_TIME).cast("timestamp")
    return V.validate(B.faulty_tables(spark, root), "batch-1", at)


@query("quarantine", O.sql(
    """SELECT entity || ':' || id AS original_record_reference, reason AS reason_code,
       CASE WHEN reason IN ('INVALID_GEOMETRY', 'INVALID_PERMIT_DATES', 'PERMIT_STATUS_DATE_MISMATCH', 'INVALID_CAPTURE_TIME')
              OR (entity = 'imagery_assets' AND reason = 'CRS_MISMATCH') THEN 'contract'
            WHEN reason = 'DUPLICATE_ASSET_HASH' THEN 'deduplication' ELSE 'relationship' END AS validation_stage,
       'batch-1' AS source_batch_id FROM judged WHERE reason IS NOT NULL""", *FAULT_TABLES, extra=FAULTS))
def quarantine(spark: SparkSession, root: str) -> DataFrame:
    _kept, rejected = _validated(spark, root)
    return rejected.drop("timestamp")


@query("kept_records", O.sql("SELECT entity, id FROM judged WHERE reason IS NULL", *FAULT_TABLES, extra=FAULTS))
def kept_records(spark: SparkSession, root: str) -> DataFrame:
    kept, _rejected = _validated(spark, root)
    parts = [df.select(F.lit(name).alias("entity"), F.col(V.KEYS[name]).alias("id")) for name, df in kept.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("catalogue_manifest", O.sql(
    """SELECT 'table' AS kind, entity AS name, count(*) FILTER (reason IS NULL) AS n FROM judged GROUP BY 2
       UNION ALL SELECT 'quarantine', reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY 2""",
    *FAULT_TABLES, extra=FAULTS))
def catalogue_manifest(spark: SparkSession, root: str) -> DataFrame:
    kept, rejected = _validated(spark, root)
    return K.manifest(kept, rejected).select("kind", "name", "n")


@query("field_violations", O.sql(
    """SELECT asset_id, CASE WHEN capture_time > ingestion_time THEN 'ORDER:capture_time' ELSE '' END AS order_violation,
       CASE WHEN box_crs <> 'EPSG:32643' THEN 1 ELSE 0 END AS crs_violation,
       CAST((capture_time > ingestion_time)::INTEGER + (box_crs <> 'EPSG:32643')::INTEGER AS BIGINT) AS violations
       FROM assets""", "assets"))
def field_violations(spark: SparkSession, root: str) -> DataFrame:
    found = V.violations(B.assets(spark, root), "imagery_assets")
    has = F.array_contains("violations", "ORDER:capture_time")
    return found.select(
        "asset_id", F.when(has, "ORDER:capture_time").otherwise("").alias("order_violation"),
        flag(F.array_contains("violations", "EQUAL:crs")).alias("crs_violation"),
        F.size("violations").cast("long").alias("violations"))


@query("sensitive_metadata", """
    SELECT page_id, CAST(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') OR regexp_matches(url, '^[^#?]*\\?[^#]')
      AS INTEGER) AS uri_secret, CAST(page_id % 6 IN (0, 2, 3) AS INTEGER) AS secret_key FROM pages""")
def sensitive_metadata(spark: SparkSession, root: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in ("Api-Key", "gain", "user_TOKEN", "authorization", "note", "offset")])
    params = F.concat(F.lit('{"model":{"'), F.get(keys, (F.col("page_id") % 6).cast("int")),
                      F.lit('":[1,"password: \\"none\\":"]},"uri":'), F.to_json(F.struct("url")), F.lit("}"))
    return B.table(spark, root, "pages").select(
        "page_id", flag(uri_has_secrets(F.col("url"))).alias("uri_secret"),
        flag(has_sensitive_key(params)).alias("secret_key"))


@query("log_safe_metadata", """
    SELECT doc_id, lang, left(text, 256) AS note, CAST(n_chars AS VARCHAR) AS size, 3 AS kept FROM documents""")
def log_safe_metadata(spark: SparkSession, root: str) -> DataFrame:
    raw = F.to_json(F.struct(
        "lang", F.col("text").alias("note"), F.col("n_chars").alias("size"), F.lit("x@y.z").alias("Email"),
        F.lit("Q").alias("citizenName"), F.struct("source").alias("nested"), F.array("source").alias("list")))
    safe = safe_metadata_json(raw)
    return B.table(spark, root, "documents").withColumn("_s", safe).select(
        "doc_id", F.col("_s")["lang"].alias("lang"), F.col("_s")["note"].alias("note"),
        F.col("_s")["size"].alias("size"), F.size("_s").alias("kept"))


@query("derived_extents", O.sql(
    f"""SELECT ward_id, min(px0) AS min_x, min(py0) AS min_y, max(px1) AS max_x, max(py1) AS max_y,
        count(*) AS parcel_count, {O.r6('sum(' + O.inter('p') + ')')} AS parcel_area FROM parcels GROUP BY 1""", "parcels"))
def derived_extents(spark: SparkSession, root: str) -> DataFrame:
    out = S.derive_extents(B.parcels(spark, root), "ward_id")
    return out.withColumn("parcel_area", round6(F.col("parcel_area")))


@query("tessellation", O.sql(
    f"""SELECT e.municipality_id, CAST(w * 20 + k AS BIGINT) AS record_index, {O.r6('x0 + w * (x1 - x0) / 5e0 + 2')} AS x0,
        {O.r6('y0 + k * (y1 - y0) / 20e0 + 2')} AS y0, {O.r6('((x1 - x0) / 5e0 - 4) * ((y1 - y0) / 20e0 - 4)')} AS cell_area
        FROM (SELECT municipality_id, min(px0) AS x0, min(py0) AS y0, max(px1) AS x1, max(py1) AS y1 FROM parcels GROUP BY 1) e,
        (SELECT unnest(generate_series(0, 4)) AS w) ws, (SELECT unnest(generate_series(0, 19)) AS k) ks""", "parcels"))
def tessellation(spark: SparkSession, root: str) -> DataFrame:
    extents = S.derive_extents(B.parcels(spark, root), "municipality_id").drop("parcel_count", "parcel_area")
    b = F.col("parcel_box")
    return S.tessellate(extents, 5, 20, 2.0).select(
        "municipality_id", F.col("record_index").cast("long").alias("record_index"), round6(b["min_x"]).alias("x0"),
        round6(b["min_y"]).alias("y0"), round6(G.area(b)).alias("cell_area"))


_RING = """'{"type":"Polygon","coordinates":[[[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1
    || '],[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || ']]]}'"""


@query("geojson_features", O.sql(
    f"""SELECT record_type, id, '{{"type":"Feature","id":"' || id || '","geometry":' || {_RING}
        || ',"properties":{{"record_type":"' || record_type || '","crs":"EPSG:32643"}}}}' AS feature FROM (
        SELECT 'parcel' AS record_type, parcel_id AS id, px0 AS x0, py0 AS y0, px1 AS x1, py1 AS y1 FROM parcels
        UNION ALL SELECT 'municipality', municipality_id, min(px0), min(py0), max(px1), max(py1) FROM parcels GROUP BY 2
        UNION ALL SELECT 'ward', ward_id, min(px0), min(py0), max(px1), max(py1) FROM parcels GROUP BY 2
        UNION ALL SELECT 'approved_footprint', footprint_id, fx0, fy0, fx1, fy1 FROM footprints
        UNION ALL SELECT 'public_boundary', boundary_id, bx, by0, bx, by1 FROM boundaries)""",
    "parcels", "footprints", "boundaries"))
def geojson_features(spark: SparkSession, root: str) -> DataFrame:
    parcels, b = B.parcels(spark, root), F.col("box")

    def extent(key: str) -> DataFrame:
        return parcels.groupBy(key, "crs").agg(
            G.box(F.min(b["min_x"]), F.min(b["min_y"]), F.max(b["max_x"]), F.max(b["max_y"])).alias("box"))

    return K.geojson_features({
        "municipalities": extent("municipality_id"), "wards": extent("ward_id"), "parcels": parcels, "approved_footprints": B.approved_footprints(spark, root),
        "public_boundaries": B.public_boundaries(spark, root)})


@query("content_hashes", """SELECT 'doc' AS kind, doc_id AS id, sha256(text) AS content_sha256 FROM documents
    UNION ALL SELECT 'page', page_id, sha256(html) FROM pages""")
def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    docs = B.table(spark, root, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_sha256"))
    return docs.unionByName(B.table(spark, root, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.sha2("html", 256).alias("content_sha256")))


@query("immutable_merge", """
    SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'stored' WHEN s.doc_id IS NULL THEN 'new'
      WHEN s.lang = i.lang AND s.n = i.n THEN 'same' ELSE 'conflict' END AS state
    FROM (SELECT doc_id, lang, n_chars AS n FROM documents WHERE doc_id % 3 <> 0) s
    FULL JOIN (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents
               WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) i ON i.doc_id = s.doc_id""")
def immutable_merge(spark: SparkSession, root: str) -> DataFrame:
    docs = B.table(spark, root, "documents").select("doc_id", "lang", F.col("n_chars").alias("n"))
    d = F.col("doc_id")
    incoming = docs.where((d % 2 == 0) | (d % 3 == 0)).withColumn("n", F.when(d % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return K.merge_immutable(docs.where(d % 3 != 0), incoming, "doc_id").select("doc_id", "state")


@query("latest_merge", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_merge(spark: SparkSession, root: str) -> DataFrame:
    rows = B.table(spark, root, "events").select("user_id", "event_type", "event_id", "ts")
    even = F.col("event_id") % 2 == 0
    return K.merge_latest(rows.where(even), rows.where(~even), "user_id", "ts").drop("ts")


@query("bundle_state", """SELECT coalesce(r.k, c.k) AS bundle_id, CASE WHEN r.k IS NULL THEN 'RESULT_MISSING'
    WHEN c.k IS NULL THEN 'CASE_MISSING' ELSE 'COMPLETE' END AS state
    FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') r
    FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') c ON c.k = r.k""")
def bundle_state(spark: SparkSession, root: str) -> DataFrame:
    orders = B.table(spark, root, "orders").select(F.col("o_orderkey").alias("bundle_id"), "o_orderstatus")
    return K.bundle_state(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus <> 'P'"))


#: Rings of every customer: a slanted polygon round a centre, and by key a bow-tie, an open ring, a point met twice, a fold, a flat one.
_RING_OF = """WITH base AS (SELECT c_custkey AS k, 40.0 * (c_custkey % 100) AS cx, 40.0 * (c_custkey // 100) AS cy FROM customer),
p AS (SELECT k, i, CASE
    WHEN k % 11 = 3 AND i IN (1, 2) THEN 3 - i WHEN k % 11 = 5 AND i = 5 THEN 4 WHEN k % 11 = 6 AND i = 4 THEN 1
    WHEN k % 11 = 7 AND i = 3 THEN 1 WHEN k % 11 = 9 AND i > 1 THEN 3 - i ELSE i % 5 END AS turn, cx, cy
    FROM base, (SELECT unnest(range(0, 6)) AS i)),
pts AS (SELECT k, i, cx + [10, 4, -7, -8, 3][1 + ((turn + 5) % 5)] + k % 3 AS x, cy + [1, 9, 6, -5, -9][1 + ((turn + 5) % 5)] AS y FROM p)"""


def _customer_rings(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    m = k % 11
    xs, ys = F.array(*map(F.lit, (10, 4, -7, -8, 3))), F.array(*map(F.lit, (1, 9, 6, -5, -9)))

    def point(i: Column) -> Column:
        turn = (
            F.when((m == 3) & i.isin(1, 2), 3 - i).when((m == 5) & (i == 5), 4).when((m == 6) & (i == 4), 1)
            .when((m == 7) & (i == 3), 1).when((m == 9) & (i > 1), 3 - i).otherwise(i % 5))
        at = (turn + 5) % 5
        return F.struct(
            (40.0 * (k % 100) + F.get(xs, at) + k % 3).cast("double").alias("x"),
            (40.0 * F.floor(k / 100) + F.get(ys, at)).cast("double").alias("y"))

    return spark.read.parquet(f"{root}/customer.parquet").select(
        F.format_string("ring-%06d", k).alias("ring_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), point).alias("ring"))


@query("ring_faults", _RING_OF + """, e AS (SELECT k, i, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pts a JOIN (SELECT k, i - 1 AS i, x, y FROM pts) b USING (k, i)
    WHERE a.x <> b.x OR a.y <> b.y),
n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, x0, y0, x1, y1 FROM e),
t AS (SELECT a.k, bool_or(CASE WHEN b.i = a.i + 1 OR (a.i = 0 AND b.i = a.n - 1)
      THEN (a.x1 - a.x0) * (b.y1 - b.y0) = (a.y1 - a.y0) * (b.x1 - b.x0) AND (a.x1 - a.x0) * (b.x1 - b.x0) + (a.y1 - a.y0) * (b.y1 - b.y0) < 0
      ELSE greatest(least(a.x0, a.x1), least(b.x0, b.x1)) <= least(greatest(a.x0, a.x1), greatest(b.x0, b.x1))
       AND greatest(least(a.y0, a.y1), least(b.y0, b.y1)) <= least(greatest(a.y0, a.y1), greatest(b.y0, b.y1))
       AND ((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * ((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0
       AND ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * ((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0 END) AS crossed
    FROM n a JOIN n b ON a.k = b.k AND a.i < b.i GROUP BY 1),
r AS (SELECT k, max(n) AS n, abs(sum(x0 * y1 - x1 * y0)) AS area2, arg_max(x1, i) <> arg_min(x0, i) OR arg_max(y1, i) <> arg_min(y0, i) AS open FROM n GROUP BY 1)
SELECT format('ring-{:06d}', k) AS ring_id, CASE WHEN n < 3 THEN 'NOT_A_RING' WHEN open THEN 'OPEN' WHEN area2 <= 0 THEN 'NO_AREA' ELSE 'CROSSING' END AS fault
FROM r LEFT JOIN t USING (k) WHERE n < 3 OR open OR area2 <= 0 OR crossed""")
def ring_faults(spark: SparkSession, root: str) -> DataFrame:
    return R.ring_faults(_customer_rings(spark, root), "ring_id")


@query("published_bundles", """WITH b AS (SELECT o_orderkey AS k, o_orderdate < DATE '1995-06-17' AS early, o_orderstatus <> 'F' AS result, o_orderstatus <> 'P' AS has_case,
      o_totalprice AS price FROM orders),
    s AS (SELECT k, price, early AND result AND has_case AS first, CASE WHEN early AND result AND has_case THEN 'STORED' WHEN NOT result THEN 'RESULT_MISSING'
      WHEN NOT has_case THEN 'CASE_MISSING' ELSE 'NEW' END AS state FROM b)
    SELECT k AS bundle_id, state, CASE WHEN state IN ('STORED', 'NEW') THEN price + CASE WHEN first THEN 0 ELSE 1 END END AS score,
      state IN ('STORED', 'NEW') AS published FROM s""")
def published_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Early orders are published first; then all of them come again with other scores, of which only new whole bundles count."""
    orders = spark.read.parquet(f"{root}/orders.parquet").select(F.col("o_orderkey").alias("bundle_id"), "o_orderdate", "o_orderstatus", "o_totalprice")
    store = BundleStore(spark, scratch_path(spark, "bundles"))
    early = orders.where("o_orderdate < date'1995-06-17'")
    halves = lambda rows, more: (
        rows.where("o_orderstatus <> 'F'").select("bundle_id", (F.col("o_totalprice") + more).alias("score")),
        rows.where("o_orderstatus <> 'P'").select("bundle_id", F.col("o_orderstatus").alias("status")))
    store.publish(*halves(early, 0))
    states = store.publish(*halves(orders, 1))
    shown = store.read("results").join(store.read("cases"), "bundle_id")
    return states.join(shown, "bundle_id", "left").select(
        "bundle_id", "state", "score", F.col("status").isNotNull().alias("published"))
