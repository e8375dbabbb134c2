"""Registered queries on evaluation, training, case logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import request_key, round2, round6
from landshift.operators import cases as L, change as D, evaluate as E
from landshift.operators.ranking import global_rank
from landshift.plans import oracle as O
from landshift.plans.raster_queries import (
    BIAS, MASK_STEPS, PIXEL_SCORED, SEG, WEIGHTS, _SIAM, _seg_logit, component_steps, difference_steps, sigmoid,
)
from landshift.plans.risk_queries import REQUESTS_SQL, flag
from landshift.sources import bindings as B, catalogue
from landshift.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


# ---------------------------------------------------------------- evaluation

def _pred(spark: SparkSession, root: str) -> DataFrame:
    """New mask as prediction of the strict new mask, per raster with a split."""
    px = B.pixels(spark, root)
    return px.select("raster_id", "row", "col", F.col("mask").alias("predicted"), F.col("strict_mask").alias("target"))


def safe_div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 1e0 ELSE ({a}) * 1e0 / ({b}) END"


@query("mask_metrics", O.sql(
    f"""SELECT raster_id, {O.r6(safe_div('tp', 'tp + fp + fn'))} AS iou, {O.r6(safe_div('2 * tp', '2 * tp + fp + fn'))} AS f1,
        {O.r6(safe_div('tp', 'tp + fp'))} AS "precision", {O.r6(safe_div('tp', 'tp + fn'))} AS recall FROM (
        SELECT raster_id, count(*) FILTER (mask = 1 AND strict_mask = 1) AS tp, count(*) FILTER (mask = 1 AND strict_mask = 0) AS fp,
          count(*) FILTER (mask = 0 AND strict_mask = 1) AS fn FROM pixels GROUP BY 1)""", "pixels"))
def mask_metrics(spark: SparkSession, root: str) -> DataFrame:
    out = E.mask_metrics(_pred(spark, root), ["raster_id"])
    return out.select("raster_id", *[round6(F.col(c)).alias(c) for c in ("iou", "f1", "precision", "recall")])


def _win(fn: str, src: str, col: str, name: str) -> str:
    return f"""SELECT a.raster_id, a.r, a.c, {fn}(b.{col}) AS {name} FROM {src} a JOIN {src} b ON b.raster_id = a.raster_id
        AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY 1, 2, 3"""


@query("boundary_f1", O.sql(
    f"""SELECT raster_id, {O.r6(safe_div('2 * x * y', 'x + y'))} AS boundary_f1 FROM (
        SELECT raster_id, {safe_div('count(*) FILTER (bp = 1 AND nt = 1)', 'count(*) FILTER (bp = 1)')} AS x,
          {safe_div('count(*) FILTER (bt = 1 AND np = 1)', 'count(*) FILTER (bt = 1)')} AS y
        FROM edges JOIN np USING (raster_id, r, c) JOIN nt USING (raster_id, r, c) GROUP BY 1)""", "pixels",
    extra={"ep": _win("min", "pixels", "mask", "v"), "et": _win("min", "pixels", "strict_mask", "v"),
           "edges": """SELECT p.raster_id, p.r, p.c, p.mask - ep.v AS bp, p.strict_mask - et.v AS bt FROM pixels p
             JOIN ep USING (raster_id, r, c) JOIN et USING (raster_id, r, c)""",
           "np": _win("max", "edges", "bp", "np"), "nt": _win("max", "edges", "bt", "nt")}))
def boundary_f1(spark: SparkSession, root: str) -> DataFrame:
    return E.boundary_f1(_pred(spark, root), ("raster_id",), ["raster_id"]).withColumn(
        "boundary_f1", round6(F.col("boundary_f1")))


@query("object_recall", O.sql(
    f"""SELECT r.raster_id, {O.r6(safe_div('coalesce(d, 0)', 'coalesce(n, 0)'))} AS object_recall,
        {O.r6(safe_div('coalesce(sd, 0)', 'coalesce(sn, 0)'))} AS small_object_recall
        FROM (SELECT DISTINCT raster_id FROM pixels) r LEFT JOIN (
          SELECT raster_id, count(*) AS n, count(*) FILTER (share >= 0.9e0) AS d, count(*) FILTER (size <= 3) AS sn,
            count(*) FILTER (size <= 3 AND share >= 0.9e0) AS sd FROM (
            SELECT k.raster_id, component, count(*) AS size, avg(b1 % 2) AS share FROM comp k
            JOIN pixels p ON p.raster_id = k.raster_id AND k.cell = p.r * 4294967296 + p.c GROUP BY 1, 2) GROUP BY 1) o
        ON o.raster_id = r.raster_id""", "pixels",
    extra={"fg": "SELECT raster_id, r, c FROM pixels WHERE strict_mask = 1", **component_steps("fg", "raster_id")}))
def object_recall(spark: SparkSession, root: str) -> DataFrame:
    px = B.pixels(spark, root).select("raster_id", "row", "col", (F.col("b1") % 2).alias("predicted"), F.col("strict_mask").alias("target"))
    out = E.object_recall(px, ("raster_id",), ["raster_id"], overlap=0.9, small=3)
    return out.select("raster_id", round6(F.col("object_recall")).alias("object_recall"),
                      round6(F.col("small_object_recall")).alias("small_object_recall"))


_P = sigmoid(_seg_logit(""))


@query("log_loss", O.sql(
    f"""SELECT {O.r6('avg(l)')} AS log_loss FROM (SELECT raster_id, avg(-(mask * ln(p) + (1 - mask) * ln(1 - p))) AS l FROM (
        SELECT raster_id, mask, greatest(1e-7, least(1 - 1e-7, {_P})) AS p FROM pixels) GROUP BY 1)""", "pixels"))
def log_loss(spark: SparkSession, root: str) -> DataFrame:
    px = D.segment(B.pixels(spark, root), SEG["weights"], SEG["bias"], SEG["mean"], SEG["std"], ["b1", "b2", "b3"])
    out = E.log_loss(px.withColumn("target", F.col("mask")), "raster_id")
    return out.select(round6(F.col("log_loss")).alias("log_loss"))


def _tiered(spark: SparkSession, root: str) -> DataFrame:
    return D.usable_pairs(B.pairs(spark, root), 0.25).withColumn("tier", E.tier_of(F.col("score"), F.col("off_nadir")))


_TIER = "CASE WHEN off_nadir OR score < 0.55e0 THEN 'difficult' WHEN score < 0.8e0 THEN 'medium' ELSE 'high' END"

EVAL_STEPS = {
    **MASK_STEPS, **difference_steps(PIXEL_SCORED),
    "grid": """SELECT m.method, x.pair_id, x.r, x.c, x.target, CASE m.method WHEN 'mask' THEN coalesce(l.label, 0)
        WHEN 'image' THEN CASE WHEN d.cell IS NOT NULL THEN 5 ELSE 0 END ELSE coalesce(s.label, 0) END AS predicted FROM pair_pixels x JOIN usable u ON u.pair_id = x.pair_id AND u.split = 'validation',
        (SELECT unnest(['mask', 'image', 'siamese']) AS method) m
        LEFT JOIN dkept d ON d.raster_id = x.pair_id AND d.cell = x.r * 4294967296 + x.c
        LEFT JOIN labelled l ON l.pair_id = x.pair_id AND l.cell = x.r * 4294967296 + x.c
        LEFT JOIN (SELECT pair_id, r, c, CASE WHEN """ + sigmoid(_SIAM) + """ >= 0.5e0 THEN 5 ELSE 0 END AS label FROM pair_pixels) s
          ON s.pair_id = x.pair_id AND s.r = x.r AND s.c = x.c""",
    "tmark": """SELECT method, 'target' AS side, pair_id, r, c, CASE WHEN predicted > 0 THEN 1 ELSE 0 END AS other FROM grid WHERE target > 0
        UNION ALL SELECT method, 'predicted', pair_id, r, c, CASE WHEN target > 0 THEN 1 ELSE 0 END FROM grid WHERE predicted > 0""",
    **component_steps("tmark", "method, side, pair_id", prefix="e"),
    "shares": """SELECT k.method, k.pair_id, k.side, k.component, avg(other) AS share FROM ecomp k JOIN tmark t ON t.method = k.method
        AND t.side = k.side AND t.pair_id = k.pair_id AND k.cell = t.r * 4294967296 + t.c GROUP BY 1, 2, 3, 4""",
    "objects": """SELECT method, pair_id, count(*) FILTER (side = 'target') AS n, count(*) FILTER (side = 'target' AND share >= 0.25e0) AS d,
        count(*) FILTER (side = 'predicted' AND share = 0) AS fa FROM shares GROUP BY 1, 2""",
    "counts": """SELECT method, pair_id, count(*) AS px, count(*) FILTER (predicted > 0 AND target > 0) AS tp,
        count(*) FILTER (predicted > 0 AND target = 0) AS fp, count(*) FILTER (predicted = 0 AND target > 0) AS fn,
        abs(count(*) FILTER (predicted IN (1, 3)) - count(*) FILTER (target IN (1, 3))) * 4e0 AS ae,
        abs(count(*) FILTER (predicted IN (2, 4)) - count(*) FILTER (target IN (2, 4))) * 4e0 AS re FROM grid GROUP BY 1, 2""",
    "sums": f"""SELECT method, coalesce(tier, '*') AS tier, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(coalesce(n, 0)) AS n,
        sum(coalesce(d, 0)) AS d, sum(coalesce(fa, 0)) AS fa, sum(px) * 4e0 AS area, sum(ae) AS ae, sum(re) AS re
        FROM (SELECT c.*, o.n, o.d, o.fa, {_TIER} AS tier FROM counts c JOIN usable u ON u.pair_id = c.pair_id
          LEFT JOIN objects o ON o.method = c.method AND o.pair_id = c.pair_id) GROUP BY GROUPING SETS ((method, tier), (method))""",
}


@query("compare_methods", O.sql(
    f"""SELECT method, tier, {O.r6(safe_div('tp', 'tp + fp + fn'))} AS iou, {O.r6(safe_div('2 * tp', '2 * tp + fp + fn'))} AS f1,
        {O.r6(safe_div('d', 'n'))} AS object_recall, {O.r6('fa / (area / 1e6)')} AS false_alarms_per_km2, fp * 4e0 AS fp_area,
        ae AS added_error, re AS removed_error FROM sums""", "pair_pixels", "pairs", extra=EVAL_STEPS))
def compare_methods(spark: SparkSession, root: str) -> DataFrame:
    px, pairs = B.pair_pixels(spark, root), _tiered(spark, root)
    sia = D.siamese(px, pairs, WEIGHTS, BIAS).where("label > 0").select("pair_id", "row", "col", "label")
    image, _ = D.image_difference(px, pairs)
    out = E.compare_methods({"mask": D.mask_difference(px, pairs), "image": image, "siamese": sia}, px, pairs, "validation")
    return out.select("method", "tier", round6(F.col("iou")).alias("iou"), round6(F.col("f1")).alias("f1"),
                      round6(F.col("object_recall")).alias("object_recall"),
                      round6(F.col("false_alarms_per_km2")).alias("false_alarms_per_km2"), "fp_area", "added_error", "removed_error")


def _linear(n: int, x: str = "c.x") -> str:
    return " + ".join([*(f"s.w{i} * {x}{i}" for i in range(n)), "s.b"])


def _descent(n: int, rate: float, epochs: int, table: str, err: str, size: str) -> str:
    """Recursive rows (e, w0.., b): the weights after e full-batch steps."""
    w = [f"w{i}" for i in range(n)]
    return f"""SELECT 0 AS e, {', '.join(f'0e0 AS {x}' for x in w)}, 0e0 AS b UNION ALL
        SELECT e + 1, {', '.join(f'{x} - {rate}e0 * g{i} / size' for i, x in enumerate(w))}, b - {rate}e0 * g / size FROM (
          SELECT e, {', '.join(w)}, b, any_value(size) AS size, {', '.join(f'sum(err * x{i}) AS g{i}' for i in range(n))}, sum(err) AS g
          FROM (SELECT s.*, {', '.join(f'c.x{i}' for i in range(n))}, ({sigmoid(_linear(n))} - c.t) * {err} AS err, {size} AS size
                FROM step s, {table} c, tot WHERE s.e < {epochs}) GROUP BY e, {', '.join(w)}, b)"""


_X = [f"abs(nb{i} / 255e0 - ob{i} / 255e0)" for i in (1, 2, 3)] + ["CAST(abs(nm - om) AS DOUBLE)"]


@query("train_siamese", O.sql(
    f"SELECT {', '.join(f'{O.r6(x)} AS {x}' for x in ('w0', 'w1', 'w2', 'w3'))}, {O.r6('b')} AS bias FROM step WHERE e = {K.SIAMESE['epochs']}",
    "pair_pixels", "pairs", extra={
        "rows": f"""SELECT {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))}, CASE WHEN target > 0 THEN 1 ELSE 0 END AS t, count(*) AS n
            FROM pair_pixels JOIN pairs USING (pair_id) WHERE split = 'train' GROUP BY ALL""",
        "tot": "SELECT CAST(sum(n) FILTER (t = 1) AS DOUBLE) AS p, CAST(sum(n) FILTER (t = 0) AS DOUBLE) AS q FROM rows",
        "step": _descent(4, K.SIAMESE["rate"], K.SIAMESE["epochs"], "rows", "c.n * CASE WHEN c.t = 1 THEN q / p ELSE 1e0 END", "q + q / p * p"),
    }))
def train_siamese(spark: SparkSession, root: str) -> DataFrame:
    train = B.pair_pixels(spark, root).join(B.pairs(spark, root).where("split = 'train'").select("pair_id"), "pair_id", "left_semi")
    model = E.train_logistic(E.siamese_features(train), 4)
    return spark.createDataFrame(
        [(*model["weights"], model["bias"])], "w0 double, w1 double, w2 double, w3 double, bias double"
    ).select(*[round6(F.col(c)).alias(c) for c in ("w0", "w1", "w2", "w3", "bias")])


_P3 = f"greatest(1e-7, least(1 - 1e-7, {sigmoid(_linear(3))}))"
_SEGMENTATION_STEPS = {
    "sized": """SELECT p.*, t.split, count(*) OVER (PARTITION BY raster_id) AS size FROM pixels p
        JOIN tiles t ON CAST(substr(t.tile_id, 6) AS BIGINT) = p.raster_id WHERE t.split IN ('train', 'validation')""",
    "norm": "SELECT " + ", ".join(f"avg({b} / 255e0) AS m{i}, stddev_pop({b} / 255e0) AS d{i}" for i, b in enumerate(("b1", "b2", "b3")))
            + " FROM sized WHERE split = 'train'",
    "rows": "SELECT " + ", ".join(f"({b} / 255e0 - m{i}) / d{i} AS x{i}" for i, b in enumerate(("b1", "b2", "b3")))
            + ", mask AS t, split, count(*) AS n, sum(1e0 / size) AS share FROM sized, norm GROUP BY ALL",
    "tot": """SELECT CAST(sum(n) FILTER (split = 'train') AS DOUBLE) AS n, sum(share) FILTER (split = 'train') AS st,
        sum(share) FILTER (split = 'validation') AS sv FROM rows""",
    "step": _descent(3, K.SEGMENTATION["rate"], K.SEGMENTATION["epochs"], "(SELECT * FROM rows WHERE split = 'train')", "c.n", "tot.n"),
    "loss": f"""SELECT e - 1 AS epoch, sum(l) FILTER (split = 'train') / any_value(st) AS tl, sum(l) FILTER (split = 'validation') / any_value(sv) AS vl
        FROM (SELECT s.e, c.split, st, sv, -(c.t * ln({_P3}) + (1 - c.t) * ln(1 - {_P3})) * c.share AS l FROM step s, rows c, tot WHERE s.e > 0) GROUP BY e""",
    "walk": f"""SELECT -1 AS epoch, 1e308 AS best, 0 AS waited, -1 AS kept UNION ALL
        SELECT l.epoch, CASE WHEN vl < best - {K.SEGMENTATION['min_delta']!r} THEN vl ELSE best END,
          CASE WHEN vl < best - {K.SEGMENTATION['min_delta']!r} THEN 0 ELSE waited + 1 END,
          CASE WHEN vl < best - {K.SEGMENTATION['min_delta']!r} THEN l.epoch ELSE kept END
        FROM walk w JOIN loss l ON l.epoch = w.epoch + 1 WHERE waited < {K.SEGMENTATION['patience']}""",
}


@query("train_segmentation", O.sql(
    f"""SELECT l.epoch, {O.r6('tl')} AS train_loss, {O.r6('vl')} AS validation_loss,
        {', '.join(f'{O.r6(f"s.{x}")} AS {x}' for x in ('w0', 'w1', 'w2'))}, {O.r6('s.b')} AS bias
        FROM walk w JOIN loss l ON l.epoch = w.epoch
        JOIN step s ON s.e = (SELECT 1 + max_by(kept, epoch) FROM walk)""", "pixels", "tiles", extra=_SEGMENTATION_STEPS))
def train_segmentation(spark: SparkSession, root: str) -> DataFrame:
    """One row per epoch with both losses, and the weights kept by early stopping beside each."""
    tiles = B.tiles(spark, root).select(F.expr("cast(substr(tile_id, 6) as bigint)").alias("raster_id"), "split")
    px = B.pixels(spark, root).join(tiles, "raster_id").select(
        F.col("raster_id").alias("sample"), "split", "b1", "b2", "b3", F.col("mask").alias("target"))
    model = E.train_segmentation(px, ["b1", "b2", "b3"])
    numbers = ("train_loss", "validation_loss", "w0", "w1", "w2", "bias")
    return spark.createDataFrame(
        [(i, t, v, *model["weights"], model["bias"]) for i, (t, v) in enumerate(model["history"])],
        "epoch int, " + ", ".join(f"{c} double" for c in numbers)
    ).select("epoch", *[round6(F.col(c)).alias(c) for c in numbers])


# ---------------------------------------------------------------- cases

def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


_ALLOWED = "CASE s.status " + " ".join(f"WHEN '{a}' THEN {_in('a.target', b)}" for a, b in K.CASE_TRANSITIONS.items() if b) + " ELSE false END"
_SUP = _in("a.actor_role", K.SUPERVISORS)
_NOT_HOLDER = "(a.actor_role = 'inspector' AND s.inspector IS DISTINCT FROM a.actor_id)"
_DECIDE = f"""CASE
    WHEN a.action = 'create' THEN CASE WHEN NOT {_SUP} THEN 'ROLE' WHEN s.status IS NOT NULL THEN 'CASE_EXISTS' END
    WHEN s.status IS NULL THEN 'CASE_NOT_FOUND'
    WHEN a.action = 'transition' THEN CASE WHEN NOT a.has_reason THEN 'REASON_REQUIRED'
      WHEN NOT ({_ALLOWED}) THEN 'INVALID_TRANSITION' WHEN a.target = 'UNDER_REVIEW' AND s.inspector IS NULL THEN 'INSPECTOR_REQUIRED'
      WHEN a.target IN ('TRIAGED', 'CONFIRMED_FOR_ADMIN_REVIEW') THEN CASE WHEN NOT {_SUP} THEN 'ROLE' END
      WHEN a.target = 'CLOSED' THEN CASE WHEN a.actor_role <> 'administrator' THEN 'ROLE' END
      WHEN {_NOT_HOLDER} THEN 'NOT_ASSIGNED_INSPECTOR' END
    WHEN a.action IN ('assign', 'reassign', 'unassign') AND NOT {_SUP} THEN 'ROLE'
    WHEN a.action IN ('assign', 'reassign') AND NOT a.inspector_active THEN 'INSPECTOR_INACTIVE'
    WHEN a.action = 'assign' THEN CASE WHEN s.inspector IS NOT NULL THEN 'ALREADY_ASSIGNED'
      WHEN NOT {_in('s.status', K.ASSIGNABLE)} THEN 'NOT_ASSIGNABLE' END
    WHEN a.action IN ('reassign', 'unassign') THEN CASE WHEN s.inspector IS NULL THEN 'NOT_ASSIGNED'
      WHEN {_in('s.status', K.SETTLED)} THEN 'CASE_SETTLED' END
    WHEN s.status = 'CLOSED' THEN 'CASE_CLOSED' WHEN {_NOT_HOLDER} THEN 'NOT_ASSIGNED_INSPECTOR' END"""
_NEW_STATUS = """CASE a.action WHEN 'create' THEN 'CREATED' WHEN 'transition' THEN a.target WHEN 'assign' THEN 'ASSIGNED'
    WHEN 'unassign' THEN CASE WHEN s.status IN ('ASSIGNED', 'UNDER_REVIEW') THEN 'TRIAGED' ELSE s.status END ELSE s.status END"""
_NEW_HOLDER = """CASE WHEN a.action IN ('assign', 'reassign') THEN a.inspector_id WHEN a.action IN ('unassign', 'create') THEN NULL
    ELSE s.inspector END"""
_ERR = f"coalesce({_DECIDE}, CASE WHEN s.updated > a.minute THEN 'OUT_OF_ORDER' END)"

JUDGE_STEPS = {
    "judged": f"""SELECT c.case_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS inspector,
        CAST(NULL AS BIGINT) AS updated, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS minute
        FROM (SELECT DISTINCT case_id FROM actions) c
        UNION ALL SELECT a.case_id, a.seq, CASE WHEN {_ERR} IS NULL THEN {_NEW_STATUS} ELSE s.status END,
          CASE WHEN {_ERR} IS NULL THEN {_NEW_HOLDER} ELSE s.inspector END, CASE WHEN {_ERR} IS NULL THEN a.minute ELSE s.updated END,
          {_ERR}, a.action, a.minute FROM judged s JOIN actions a ON a.case_id = s.case_id AND a.seq = s.seq + 1""",
}
JUDGED_SQL = O.sql(
    """SELECT case_id, seq, action, coalesce(error_code, '') AS error_code, coalesce(status, '') AS status,
       coalesce(inspector, '') AS inspector FROM judged WHERE seq >= 0""", "actions", extra=JUDGE_STEPS)


def _judged_view(judged: DataFrame) -> DataFrame:
    text = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    return judged.select("case_id", "seq", "action", text("error_code", "error_code"), text("after_status", "status"),
                         text("after_inspector", "inspector"))


@query("judged_actions", JUDGED_SQL)
def judged_actions(spark: SparkSession, root: str) -> DataFrame:
    return _judged_view(L.judge_actions(B.case_actions(spark, root)))


@query("case_stream", JUDGED_SQL)
def case_stream(spark: SparkSession, root: str) -> DataFrame:
    actions = B.as_actions(streams.stream_table(spark, root, "conversations"))
    return _judged_view(streams.run_case_stream(actions, spark))


SNAPSHOT_STEPS = {
    **JUDGE_STEPS,
    "snaps": """SELECT case_id, arg_max(coalesce(status, ''), seq) AS status, arg_max(coalesce(inspector, ''), seq) AS inspector_id,
        count(*) FILTER (error_code IS NULL) AS accepted, count(*) FILTER (error_code IS NOT NULL) AS refused,
        count(*) FILTER (error_code IS NULL AND action = 'note') AS notes,
        count(*) FILTER (error_code IS NULL AND action IN ('assign', 'reassign', 'unassign')) AS assignments
        FROM judged WHERE seq >= 0 GROUP BY 1""",
}


def _snapshots(spark: SparkSession, root: str) -> DataFrame:
    s = L.case_snapshots(L.judge_actions(B.case_actions(spark, root)))
    return s.withColumn("status", F.coalesce("status", F.lit(""))).withColumn("inspector_id", F.coalesce("inspector_id", F.lit("")))


@query("case_snapshots", O.sql("SELECT * FROM snaps", "actions", extra=SNAPSHOT_STEPS))
def case_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _snapshots(spark, root).select("case_id", "status", "inspector_id", "accepted", "refused", "notes", "assignments")


_LIST = {**SNAPSHOT_STEPS, "listed": """SELECT case_id, status, accepted * 10 + notes AS score FROM snaps
    WHERE status IN ('TRIAGED', 'ASSIGNED', 'UNDER_REVIEW')"""}


def _listable(spark: SparkSession, root: str) -> DataFrame:
    s = _snapshots(spark, root).select("case_id", "status", "inspector_id", "created_at",
                                       (F.col("accepted") * 10 + F.col("notes")).alias("score"))
    return s.where(F.col("status").isin("TRIAGED", "ASSIGNED", "UNDER_REVIEW"))


@query("case_page", O.sql("SELECT case_id, status, score FROM listed ORDER BY score DESC, case_id LIMIT 25 OFFSET 5", "actions", extra=_LIST))
def case_page(spark: SparkSession, root: str) -> DataFrame:
    page, _total = L.list_cases(_listable(spark, root), offset=5, limit=25)
    return page.select("case_id", "status", "score")


_NUMBER = "CAST(regexp_extract(s.case_id, '(\\d+)$', 1) AS BIGINT)"


@query("case_listing", O.sql(
    """SELECT 'page' AS kind, case_id, status, inspector_id, score, NULL AS n FROM (SELECT * FROM found ORDER BY score DESC, case_id LIMIT 20 OFFSET 2)
       UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, count(*) FROM found""", "actions",
    extra={**_LIST, "found": f"""SELECT s.case_id, s.status, s.inspector_id, l.score FROM snaps s JOIN listed l ON l.case_id = s.case_id
        JOIN (SELECT case_id, min(minute) AS created FROM judged WHERE seq >= 0 AND error_code IS NULL AND action = 'create' GROUP BY 1) t
          ON t.case_id = s.case_id
        WHERE {_NUMBER} % 2 = 1 AND {_NUMBER} % 3 < 2 AND l.score >= 25 AND s.status <> 'UNDER_REVIEW'
          AND created >= 30 AND created <= 2 * 24 * 60"""}))
def case_listing(spark: SparkSession, root: str) -> DataFrame:
    """Filters of the listing together, with the total beside the page."""
    k = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
    cases = _listable(spark, root).select(
        "*", F.concat(F.lit("mun-"), (k % 2).cast("string")).alias("municipality_id"),
        F.concat(F.lit("ward-"), (k % 3).cast("string")).alias("ward_id"),
        F.when(F.col("score") >= 25, "HIGH").otherwise("LOW").alias("level"))
    page, total = L.list_cases(
        cases, offset=2, limit=20, municipality_id="mun-1", ward_id=["ward-0", "ward-1"], level="HIGH",
        status=["ASSIGNED", "TRIAGED"], created_from="2024-03-01 00:30:00", created_until="2024-03-03 00:00:00")
    return page.select(F.lit("page").alias("kind"), "case_id", "status", "inspector_id", "score", F.lit(None).cast("long").alias("n")).unionByName(
        total.select(F.lit("total").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("case_id", "string"), ("status", "string"), ("inspector_id", "string"), ("score", "long"))], F.col("total").alias("n")))


@query("case_ranking", O.sql(
    "SELECT case_id, status, score, row_number() OVER (ORDER BY score DESC, case_id) AS place FROM listed", "actions", extra=_LIST))
def case_ranking(spark: SparkSession, root: str) -> DataFrame:
    rows = _listable(spark, root).select("case_id", "status", "score")
    return global_rank(rows, [F.col("score").desc(), F.col("case_id").asc()], "place")


def _events(spark: SparkSession, root: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("case_id", "action", "target", "actor_id", "details_sha256")}
    return B.case_actions(spark, root).select(
        "case_id", "seq", L.event_body({**fields, "seq": F.col("seq")}).alias("body_sha256"))


CHAIN_STEPS = {
    "bodies": """SELECT case_id, seq, sha256('{"action":"' || action || '","actor_id":"' || actor_id || '","case_id":"' || case_id
        || '","details_sha256":"' || details_sha256 || '","seq":' || seq || ',"target":"' || target || '"}') AS body FROM actions""",
    "links": """SELECT case_id, seq, body, CAST(NULL AS VARCHAR) AS previous_hash, sha256('root' || body) AS event_hash FROM bodies WHERE seq = 0
        UNION ALL SELECT b.case_id, b.seq, b.body, l.event_hash, sha256(l.event_hash || b.body) FROM links l
        JOIN bodies b ON b.case_id = l.case_id AND b.seq = l.seq + 1""",
}


@query("hash_chain", O.sql(
    "SELECT case_id, seq, body AS body_sha256, coalesce(previous_hash, '') AS previous_hash, event_hash FROM links",
    "actions", extra=CHAIN_STEPS))
def hash_chain(spark: SparkSession, root: str) -> DataFrame:
    return L.build_chain(_events(spark, root)).withColumn("previous_hash", F.coalesce("previous_hash", F.lit("")))


@query("verified_chain", O.sql(
    """SELECT case_id, count(*) AS events, CAST(CASE WHEN count(*) > 3 AND CAST(substr(case_id, 6) AS BIGINT) % 4 = 0 THEN 2 ELSE -1 END AS BIGINT)
       AS first_broken FROM actions GROUP BY 1""", "actions"))
def verified_chain(spark: SparkSession, root: str) -> DataFrame:
    """Every fourth case has its third event tampered with."""
    number = F.substring("case_id", 6, 20).cast("long")
    bad = (number % 4 == 0) & (F.col("seq") == 2)
    chain = L.build_chain(_events(spark, root))
    sizes = chain.groupBy("case_id").agg(F.count("*").alias("_n"))
    tampered = chain.join(sizes, "case_id").withColumn(
        "body_sha256", F.when(bad & (F.col("_n") > 3), F.sha2("body_sha256", 256)).otherwise(F.col("body_sha256"))).drop("_n")
    return L.verify_chain(tampered).select("case_id", "events", F.coalesce("first_broken", F.lit(-1)).alias("first_broken"))


# ---------------------------------------------------------------- evidence

def _evidence(spark: SparkSession, root: str) -> DataFrame:
    """One asset per turn, derived from the turn before, with planted faults by text length."""
    n, t, c = F.length("text"), F.col("turn"), F.col("conv_id")
    asset = lambda turn: F.concat_ws("-", F.lit("ev"), c.cast("string"), turn.cast("string"))
    return B.table(spark, root, "conversations").select(
        F.concat(F.lit("case-"), c.cast("string")).alias("case_id"), t.alias("position"),
        F.when((n % 13 == 0) & (t > 0), asset(t - 1)).otherwise(asset(t)).alias("asset_id"),
        F.when(n % 17 == 0, F.sha2(c.cast("string"), 256)).otherwise(F.sha2("text", 256)).alias("content_sha256"),
        F.when((t > 0) & (n % 7 == 0), F.sha2(F.lit("other"), 256)).otherwise(
            F.sha2(F.concat(F.lit("src-"), c.cast("string")), 256)).alias("original_sha256"),
        F.when((t > 0) & (n % 11 == 0), F.lit("ev-gone")).when((t > 0) & (n % 3 == 0), asset(t - 1)).alias("source_asset_id"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 9 == 0, F.sha2(F.lit("forged"), 256)).otherwise(
            F.when(n % 17 == 0, F.sha2(c.cast("string"), 256)).otherwise(F.sha2("text", 256))).alias("actual_sha256"))


EVIDENCE_STEPS = {
    "ev": """SELECT 'case-' || conv_id AS case_id, turn AS position,
        'ev-' || conv_id || '-' || CASE WHEN length(text) % 13 = 0 AND turn > 0 THEN turn - 1 ELSE turn END AS asset_id,
        CASE WHEN length(text) % 17 = 0 THEN sha256(CAST(conv_id AS VARCHAR)) ELSE sha256(text) END AS content_sha256,
        CASE WHEN turn > 0 AND length(text) % 7 = 0 THEN sha256('other') ELSE sha256('src-' || conv_id) END AS original_sha256,
        CASE WHEN turn > 0 AND length(text) % 11 = 0 THEN 'ev-gone' WHEN turn > 0 AND length(text) % 3 = 0
          THEN 'ev-' || conv_id || '-' || (turn - 1) END AS source_asset_id,
        CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 9 = 0 THEN sha256('forged')
          WHEN length(text) % 17 = 0 THEN sha256(CAST(conv_id AS VARCHAR)) ELSE sha256(text) END AS actual_sha256
        FROM conversations""",
}


@query("custody_report", O.sql(
    """SELECT e.case_id, e.position, e.asset_id, coalesce(CASE
         WHEN e.position > (SELECT min(position) FROM ev x WHERE x.case_id = e.case_id AND x.asset_id = e.asset_id) THEN 'DUPLICATE_ID'
         WHEN e.position > (SELECT min(position) FROM ev x WHERE x.case_id = e.case_id AND x.content_sha256 = e.content_sha256) THEN 'DUPLICATE_CONTENT'
         WHEN e.source_asset_id IS NOT NULL AND s.asset_id IS NULL THEN 'MISSING_SOURCE'
         WHEN e.source_asset_id IS NOT NULL AND e.original_sha256 <> s.sha THEN 'SOURCE_HASH_MISMATCH' END, '') AS custody_error
       FROM ev e LEFT JOIN (SELECT case_id, asset_id, arg_max(content_sha256, position) AS sha FROM ev GROUP BY 1, 2) s
         ON s.case_id = e.case_id AND s.asset_id = e.source_asset_id""", extra=EVIDENCE_STEPS))
def custody_report(spark: SparkSession, root: str) -> DataFrame:
    out = L.custody_report(_evidence(spark, root).drop("actual_sha256"))
    return out.select("case_id", "position", "asset_id", F.coalesce("custody_error", F.lit("")).alias("custody_error"))


@query("content_check", O.sql(
    """SELECT case_id, position, CASE WHEN actual_sha256 IS NULL THEN 'CONTENT_UNAVAILABLE' WHEN actual_sha256 <> content_sha256
       THEN 'CONTENT_MISMATCH' ELSE '' END AS content_error FROM ev""", extra=EVIDENCE_STEPS))
def content_check(spark: SparkSession, root: str) -> DataFrame:
    e = _evidence(spark, root).withColumn("asset_id", F.concat_ws("/", "case_id", F.col("position").cast("string")))
    out = L.content_check(e.drop("actual_sha256"), e.select("asset_id", "actual_sha256"))
    return out.select("case_id", "position", F.coalesce("content_error", F.lit("")).alias("content_error"))


@query("lineage_levels", """
    WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN length(text) % 29 = 0 AND turn < 7 THEN turn + 1 WHEN turn > 0 AND length(text) % 4 <> 0
        THEN turn - 1 END AS up FROM conversations),
    ok AS (SELECT n.conv_id, n.turn, p.turn AS up FROM n LEFT JOIN n p ON p.conv_id = n.conv_id AND p.turn = n.up),
    w AS (SELECT conv_id, turn, 0 AS level FROM ok WHERE up IS NULL
      UNION ALL SELECT o.conv_id, o.turn, w.level + 1 FROM ok o JOIN w ON w.conv_id = o.conv_id AND w.turn = o.up)
    SELECT 'case-' || ok.conv_id AS case_id, ok.turn || '' AS asset_id, CAST(coalesce(w.level, -1) AS BIGINT) AS level,
      CAST(w.level IS NULL AS INTEGER) AS in_cycle FROM ok LEFT JOIN w ON w.conv_id = ok.conv_id AND w.turn = ok.turn""")
def lineage_levels(spark: SparkSession, root: str) -> DataFrame:
    n, t = F.length("text"), F.col("turn")
    e = B.table(spark, root, "conversations").select(
        F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("case_id"), t.cast("string").alias("asset_id"),
        F.when((n % 29 == 0) & (t < 7), t + 1).when((t > 0) & (n % 4 != 0), t - 1).cast("string").alias("source_asset_id"))
    return L.lineage_levels(e).select("case_id", "asset_id", F.coalesce("level", F.lit(-1)).alias("level"), flag("in_cycle").alias("in_cycle"))


@query("case_packages", O.sql(
    """SELECT case_id, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS position, sha256('{"accepted":' || accepted || ',"schema_version":"1.0.0","status":"'
         || status || '"}') AS line_sha256 FROM snaps
       UNION ALL SELECT case_id, 1, position, sha256('{"asset_id":"' || asset_id || '","content_sha256":"' || content_sha256 || '","position":'
         || position || '}') FROM ev
       UNION ALL SELECT case_id, 2, seq, sha256('{"event_hash":"' || event_hash || '","previous_hash":' || coalesce('"' || previous_hash || '"', 'null')
         || ',"seq":' || seq || '}') FROM links""", "actions", extra={**SNAPSHOT_STEPS, **CHAIN_STEPS, **EVIDENCE_STEPS}))
def case_packages(spark: SparkSession, root: str) -> DataFrame:
    cases = _snapshots(spark, root).select("case_id", "status", "accepted")
    evidence = _evidence(spark, root).select("case_id", "position", "asset_id", "content_sha256")
    events = L.build_chain(_events(spark, root)).select("case_id", "seq", "previous_hash", "event_hash")
    return catalogue.case_packages(cases, evidence, events).select("case_id", "part", "position", "line_sha256")


# ---------------------------------------------------------------- failures, models, metrics

_KINDS = list(K.FAILURE_CODES) + ["unknown"]


@query("failure_codes", "SELECT event_id, CASE event_id % 18 " + " ".join(
    f"WHEN {i} THEN '{K.FAILURE_CODES.get(k, K.FAILURE_DEFAULT)[0]}'" for i, k in enumerate(_KINDS)) + """ END AS failure_code,
    CAST(event_id % 18 IN (14, 15, 16) AS INTEGER) AS transient FROM events""")
def failure_codes(spark: SparkSession, root: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    errors = B.table(spark, root, "events").select("event_id", F.get(kinds, (F.col("event_id") % 18).cast("int")).alias("error_kind"))
    return L.classify_failures(errors).select("event_id", "failure_code", flag("transient").alias("transient"))


@query("model_mismatches", """
    SELECT p_partkey AS request_id, CASE WHEN p_partkey % 50 = 49 THEN '' ELSE concat_ws('|', CASE WHEN p_partkey % 3 = 0 THEN 'model_version' END,
        CASE WHEN p_partkey % 7 = 0 THEN 'normalization' END) END AS mismatches,
      CASE WHEN p_partkey % 50 = 49 THEN 'MODEL_NOT_AVAILABLE' WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'MODEL_SCHEMA_MISMATCH'
        WHEN p_partkey % 11 = 0 THEN 'CRS_NOT_SUPPORTED' WHEN p_size > 40 THEN 'RESOLUTION_NOT_SUPPORTED' ELSE '' END AS error_code FROM part""")
def model_mismatches(spark: SparkSession, root: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    parts = B.table(spark, root, "part")
    limits = F.array(F.lit(0.0), F.lit(20.0))
    crs = F.array(F.lit("EPSG:32643"))
    models = B.table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("artifact_id"), F.lit("seg").alias("model_name"), F.lit("1").alias("model_version"),
        F.lit("z").alias("normalization"), crs.alias("required_crs"), limits.alias("supported_resolution_m"))
    asked = parts.select(
        p.alias("request_id"), F.when(p % 50 == 49, -1).otherwise(p % 10).alias("artifact_id"), F.lit("seg").alias("model_name"),
        F.when(p % 3 == 0, "2").otherwise("1").alias("model_version"), F.when(p % 7 == 0, "q").otherwise("z").alias("normalization"),
        crs.alias("required_crs"), limits.alias("supported_resolution_m"),
        F.when(p % 11 == 0, "EPSG:4326").otherwise("EPSG:32643").alias("source_crs"), (size / 2.0).alias("source_resolution_m"))
    fields = ("model_name", "model_version", "normalization", "required_crs", "supported_resolution_m")
    out = L.model_mismatches(asked, models, fields)
    return out.select("request_id", F.coalesce(F.array_join("mismatches", "|"), F.lit("")).alias("mismatches"),
                      F.coalesce("error_code", F.lit("")).alias("error_code"))


def _event_stream(spark: SparkSession, root: str) -> DataFrame:
    events = streams.stream_table(spark, root, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("metrics_stream", f"""
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, code, n, {O.r2('total')} AS total_seconds FROM (
      SELECT date_trunc('hour', ts) AS s, event_type AS code, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
    WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def metrics_stream(spark: SparkSession, root: str) -> DataFrame:
    events = _event_stream(spark, root).select("ts", F.col("event_type").alias("code"), F.col("value").alias("seconds"))
    rows = streams.run_to_table(streams.metrics_stream(events), spark, "metrics")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "code", "n",
                       round2(F.col("total_seconds")).alias("total_seconds"))


@query("dedupe_stream", f"SELECT DISTINCT request_key FROM ({REQUESTS_SQL})")
def dedupe_stream(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    keyed = _event_stream(spark, root).select("ts", request_key(
        F.array(F.sha2(F.concat(F.lit("old-"), u), 256), F.sha2(F.concat(F.lit("new-"), u), 256)),
        F.concat(F.lit("pair-"), u), F.sha2("props", 256), F.col("event_type"), F.lit("1.0.0"), F.lit("process_pair")).alias("request_key"))
    return streams.run_to_table(streams.dedupe_stream(keyed, delay="60 days"), spark, "requests").select("request_key")
