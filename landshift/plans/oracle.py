"""ANSI-SQL twins of the bindings, for side-by-side checks in another engine.

``sql(body, *names)`` prepends the named common table expressions and what they build on.
"""

from __future__ import annotations

LX = "CAST(({k}) % 64 * 100 AS DOUBLE)"
LY = "CAST(floor(({k}) / 64.0) * 100 AS DOUBLE)"


def lx(k: str) -> str:
    return LX.format(k=k)


def ly(k: str) -> str:
    return LY.format(k=k)


def parcel_sides(k: str) -> tuple[str, str, str, str]:
    x, y = f"({lx(k)} + 5)", f"({ly(k)} + 5)"
    return x, y, f"({x} + 90 + CASE WHEN {k} % 7 = 0 THEN 20 ELSE 0 END)", f"({y} + 90)"


def footprint_sides(k: str) -> tuple[str, str, str, str]:
    x = f"({lx(k)} + 5 + CASE WHEN {k} % 11 = 0 THEN 1 ELSE 10 + {k} % 5 END)"
    y = f"({ly(k)} + 15 + {k} % 3)"
    return x, y, f"({x} + 30 + {k} % 4 * 5)", f"({y} + 30 + {k} % 3 * 10)"


def _sides(values, prefix: str) -> str:
    return ", ".join(f"CAST({v} AS DOUBLE) AS {prefix}{n}" for v, n in zip(values, ("x0", "y0", "x1", "y1")))


_P = parcel_sides("c_custkey")
_F = footprint_sides("c_custkey")
_K = footprint_sides("o_custkey")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "parcels": ((), f"""
        SELECT c_custkey AS ordinal, 'parcel-' || c_custkey AS parcel_id, 'ward-' || c_nationkey AS ward_id,
               'mun-' || n_regionkey AS municipality_id,
               'zone-' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS zone,
               {_sides(_P, 'p')}
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "footprints": ((), f"""
        SELECT c_custkey * 2 AS ordinal, 'fp-' || c_custkey AS footprint_id, 'bld-' || c_custkey AS building_id,
               'parcel-' || c_custkey AS parcel_id, 1 + c_custkey % 2 AS plan_version, {_sides(_F, 'f')}
        FROM customer
        UNION ALL
        SELECT c_custkey * 2 + 1, 'late-fp-' || c_custkey, 'late-bld-' || c_custkey, 'parcel-' || c_custkey,
               2 + c_custkey % 2, {_F[0]}, {_F[1]}, {_F[2]} + 5, {_F[3]} + 5
        FROM customer WHERE c_custkey % 10 = 0"""),
    "permits": ((), """
        SELECT 'permit-' || o_orderkey AS permit_id,
               CASE WHEN o_custkey % 50 = 0 THEN 'parcel-gone-' ELSE 'parcel-' END || o_custkey AS parcel_id,
               'fp-' || o_custkey AS footprint_id, 1 + o_orderkey % 2 AS plan_version,
               CAST(o_orderdate AS DATE) AS valid_from,
               CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 11 * 30 AS INTEGER) AS valid_until
        FROM orders"""),
    "changes": ((), f"""
        SELECT 'chg-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
                 || strftime(l_shipdate, '%Y%m%d') AS change_id,
               'parcel-' || o_custkey AS parcel_id, CAST(l_shipdate AS DATE) AS capture_date,
               l_shipdate AS capture_time, 1 + l_partkey % 2 AS plan_version,
               {lx('o_custkey')} + l_partkey % 100 AS cx0, {ly('o_custkey')} + l_suppkey % 80 AS cy0,
               {lx('o_custkey')} + l_partkey % 100 + 5 + l_quantity AS cx1,
               {ly('o_custkey')} + l_suppkey % 80 + 5 + l_partkey % 20 AS cy1,
               {_K[0]} AS ox0, {_K[1]} AS oy0, {_K[2]} - 5 AS ox1, {_K[3]} AS oy1,
               {_K[0]} AS nx0, {_K[1]} + l_partkey % 3 AS ny0, {_K[2]} + l_linenumber * 2 - 6 AS nx1,
               {_K[3]} + l_suppkey % 5 - 2 AS ny1,
               round(abs(l_discount) * 10, 1) AS change_confidence,
               round(0.6e0 + abs(l_tax) * 4, 2) AS registration_quality,
               least(l_linenumber % 5, 4) AS warning_count,
               l_partkey % 400 AS age_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "rule_sets": ((), """
        SELECT 'rules-' || r_regionkey || '-' || z || '-' || y || '-' || twin AS rule_set_id,
               'mun-' || r_regionkey AS municipality_id, 'zone-' || z AS zone,
               make_date(y, 1, 1) AS effective_from,
               CASE WHEN y < 2001 THEN make_date(y, 12, 31) END AS effective_until,
               CASE WHEN y % 3 <> 0 THEN 0.2e0 + (y % 4) * 0.125e0 END AS maximum_site_coverage,
               CAST(y % 4 + 3 AS DOUBLE) AS setback_metres, 180 + r_regionkey * 30 AS freshness
        FROM region, (SELECT unnest(generate_series(1995, 2001))::INTEGER AS y) ys,
             (SELECT unnest(['a', 'b']) AS z) zs, (SELECT unnest([0, 1]) AS twin) ts
        WHERE NOT (r_regionkey = 3 AND y = 1996) AND (twin = 0 OR (r_regionkey = 2 AND y = 1998))"""),
    "boundaries": ((), """
        SELECT 'road-edge-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS boundary_id,
               CAST(n_nationkey * 256 % 6400 + 20 AS DOUBLE) AS bx, 0.0e0 AS by0, 24000.0e0 AS by1
        FROM nation"""),
    "complaints": ((), f"""
        SELECT event_id AS ordinal, 'complaint-' || event_id AS complaint_id,
               'parcel-' || (user_id * 10 + event_id % 10) AS parcel_id,
               {lx('user_id * 10 + event_id % 10')} + 5 + value AS x,
               {ly('(user_id * 10 + event_id % 10)')} + 5 + event_id % 40 AS y,
               ts AS received_at, event_type AS description, sha256(props) AS media_sha256,
               CAST(floor(value * 100) AS BIGINT) % 65536 AS hash_code
        FROM events"""),
    "assets": ((), f"""
        SELECT doc_id AS ordinal, 'asset-' || doc_id AS asset_id, 'mun-' || doc_id % 5 AS municipality_id, source,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS capture_time,
               TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER))
                 + to_hours(CASE WHEN doc_id % 37 = 0 THEN -3 ELSE 5 END) AS ingestion_time,
               CASE WHEN doc_id % 41 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS box_crs,
               0.5e0 + doc_id % 4 * 0.5e0 AS resolution_m,
               CAST(doc_id % 40 * 50 AS DOUBLE) AS ax0, 0.0e0 AS ay0,
               doc_id % 40 * 50 + 64.0e0 + doc_id % 5 * 16 AS ax1, 64.0e0 + doc_id % 5 * 16 AS ay1,
               sha256(text) AS content_sha256,
               CASE WHEN doc_id % 9 = 0 THEN 1 WHEN doc_id % 13 = 0 THEN 4 ELSE 3 END AS band_count,
               n_chars AS byte_size
        FROM documents"""),
    "flat": ((), """
        SELECT vec_id, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e
        FROM embeddings"""),
    "grays": (("flat",), """
        SELECT vec_id, i, e, greatest(0, least(255, CAST(floor(e * 400 + 128) AS BIGINT))) AS g FROM flat"""),
    "pixels": (("grays",), """
        SELECT vec_id AS raster_id, CAST(floor(i / 8.0) AS BIGINT) AS r, i % 8 AS c, g AS b1, g * 3 % 256 AS b2,
               (g + i * 5) % 256 AS b3, (vec_id + i) % 23 <> 0 AS valid,
               CASE WHEN e > 0.03 THEN 1 ELSE 0 END AS mask, CASE WHEN e > 0.06 THEN 1 ELSE 0 END AS strict_mask
        FROM grays"""),
    "raster_meta": ((), """
        SELECT vec_id AS raster_id, CASE WHEN vec_id % 31 = 0 THEN 2 ELSE 3 END AS band_count,
               vec_id % 29 = 0 AS wrong_order, CAST(vec_id % 50 * 14 AS DOUBLE) AS rx
        FROM embeddings"""),
    "pairs": ((), """
        SELECT CAST(vec_id / 2 AS BIGINT) AS pair_id, vec_id AS old_id, vec_id + 1 AS new_id,
               0.2e0 + label * 0.08e0 AS score, label = 7 AS off_nadir, vec_id % 34 <> 0 AS transform_plausible,
               CASE WHEN vec_id % 38 = 0 THEN 0.0e0 ELSE 0.9e0 END AS overlap_ratio, 4.0e0 AS pixel_area,
               vec_id % 3 AS warning_count,
               CASE WHEN label < 5 THEN 'train' WHEN label < 8 THEN 'validation' ELSE 'test' END AS split
        FROM embeddings WHERE vec_id % 2 = 0"""),
    "pair_pixels": (("pixels",), """
        SELECT CAST(floor(o.raster_id / 2.0) AS BIGINT) AS pair_id, o.r, o.c,
               o.b1 AS ob1, o.b2 AS ob2, o.b3 AS ob3, n.b1 AS nb1, n.b2 AS nb2, n.b3 AS nb3,
               o.mask AS om, n.mask AS nm, o.valid AS ov, n.valid AS nv,
               CASE WHEN n.strict_mask = 1 AND o.strict_mask = 0 THEN 1
                    WHEN o.strict_mask = 1 AND n.strict_mask = 0 THEN 2 ELSE 0 END AS target
        FROM pixels o JOIN pixels n ON n.raster_id = o.raster_id + 1 AND n.r = o.r AND n.c = o.c
        WHERE o.raster_id % 2 = 0"""),
    "tiles": ((), """
        SELECT 'tile-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS tile_id,
               'region-' || label || '-' || CAST(floor(vec_id / 10.0) AS BIGINT) AS region_group,
               CAST(vec_id % 50 * 14 AS DOUBLE) AS tx0, floor(vec_id / 50.0) * 20.0 AS ty0,
               CAST(vec_id % 50 * 14 + 8 + vec_id % 7 AS DOUBLE) AS tx1, floor(vec_id / 50.0) * 20.0 + 16 AS ty1,
               sha256(array_to_string(list_transform(embedding,
                 lambda e: CAST(CAST(floor(CAST(e AS DOUBLE) * 20) AS BIGINT) AS VARCHAR)), ',')) AS tile_sha256,
               CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split
        FROM embeddings"""),
    "picked": ((), """
        SELECT conv_id, turn, length(text) AS n, text,
          CASE WHEN length(text) % 6 = 0 AND turn > 0
            THEN (['note', 'unassign', 'reassign', 'evidence', 'transition:CONFIRMED_FOR_ADMIN_REVIEW'])
                 [length(text) % 5 + 1]
            ELSE (['create', 'transition:TRIAGED', 'assign', 'transition:UNDER_REVIEW', 'note',
                   'transition:REINSPECTION_REQUIRED', 'transition:DISMISSED', 'transition:CLOSED'])
                 [least(turn, 7) + 1] END AS pick,
          CASE WHEN turn = 0 OR length(text) % 7 < 3 THEN 'supervisor'
               WHEN length(text) % 7 < 5 THEN 'administrator' ELSE 'inspector' END AS actor_role
        FROM conversations"""),
    "actions": (("picked",), """
        SELECT 'case-' || conv_id AS case_id, turn AS seq,
               conv_id * 7 + turn * 60 + CASE WHEN n % 19 = 0 THEN -90 ELSE 0 END AS minute,
               CASE WHEN actor_role = 'inspector' THEN 'insp-' || n % 2 ELSE 'act-' || actor_role END AS actor_id,
               actor_role, split_part(pick, ':', 1) AS action, split_part(pick, ':', 2) AS target,
               'insp-' || n % 2 AS inspector_id, n % 17 <> 0 AS inspector_active,
               n % 23 <> 0 AS has_reason, sha256(text) AS details_sha256,
               CASE WHEN n % 23 = 0 THEN ' ' ELSE 'turn ' || turn END AS reason
        FROM picked"""),
}


def with_tables(*names: str) -> str:
    """WITH clause holding the named tables after those they are built on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A full statement: bindings, further named steps, then the body."""
    parts = [with_tables(*names)] if names else []
    for name, text in (extra or {}).items():
        parts.append(f"{name} AS ({text})" if parts else f"WITH RECURSIVE {name} AS ({text})")
    return ", ".join(parts) + "\n" + body


def r6(x: str) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * 1000000e0, 0) / 1000000e0"


def r2(x: str) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * 100e0, 0) / 100e0"


def inter(*prefixes: str) -> str:
    """Intersection area of boxes given by column prefixes such as ('n', 'o')."""
    def many(fn: str, side: str) -> str:
        return f"{fn}({', '.join(p + side for p in prefixes)})" if len(prefixes) > 1 else prefixes[0] + side

    w = f"greatest({many('least', 'x1')} - {many('greatest', 'x0')}, 0e0)"
    h = f"greatest({many('least', 'y1')} - {many('greatest', 'y0')}, 0e0)"
    return f"({w} * {h})"
