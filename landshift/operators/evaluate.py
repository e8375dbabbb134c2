"""Mask and change metrics from counts; training on compressed feature tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from landshift.functions import constants as K
from landshift.functions.scalars import ratio
from landshift.operators import raster as R
from landshift.operators.change import difference_features, logistic
from landshift.session import cut_lineage

_ADDED = (K.ADDED, K.EXPANSION)
_REMOVED = (K.REMOVED, K.PARTIAL_DEMOLITION)


# ---------------------------------------------------------------- masks

def mask_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """IoU, F1, precision, recall of predicted against target (> 0 is foreground)."""
    p, t = F.col("predicted") > 0, F.col("target") > 0
    counts = pred.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return with_overlap_metrics(counts)


def with_overlap_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("iou", ratio(tp, tp + fp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    )


def boundary_f1(pred: DataFrame, key: R.Key, by: list[str], tolerance: int = K.BOUNDARY_TOLERANCE) -> DataFrame:
    """F1 of mask boundaries within a tolerance. Needs the full grid of 0/1 predicted and target."""
    names, rows, cols = ("predicted", "target"), R.along_row(key), R.along_col(key)

    def slide(df: DataFrame, fn, source: str, out: str, spec, radius: int) -> DataFrame:
        return df.select("*", *[fn(f"{source}{n}").over(spec.rangeBetween(-radius, radius)).alias(f"{out}{n}") for n in names])

    # both masks share each pass, and passes along columns follow each other: three shuffles in all
    grid = slide(slide(pred, F.min, "", "_h_", rows, 1), F.min, "_h_", "_e_", cols, 1)
    grid = grid.select("*", *[(F.col(n) - F.col(f"_e_{n}")).alias(f"_b_{n}") for n in names])
    grid = slide(slide(grid, F.max, "_b_", "_w_", cols, tolerance), F.max, "_w_", "_n_", rows, tolerance)
    bp, bt = F.col("_b_predicted") == 1, F.col("_b_target") == 1
    c = grid.groupBy(*by).agg(
        F.count_if(bp & (F.col("_n_target") == 1)).alias("_ph"), F.count_if(bp).alias("_p"),
        F.count_if(bt & (F.col("_n_predicted") == 1)).alias("_th"), F.count_if(bt).alias("_t"))
    precision, recall = ratio(F.col("_ph"), F.col("_p")), ratio(F.col("_th"), F.col("_t"))
    return c.withColumn("_x", precision).withColumn("_y", recall).withColumn(
        "boundary_f1", ratio(2 * F.col("_x") * F.col("_y"), F.col("_x") + F.col("_y"))
    ).select(*by, "boundary_f1")


def object_counts(pred: DataFrame, key: R.Key, by: list[str], overlap: float = K.OBJECT_OVERLAP,
                  small: int = K.SMALL_OBJECT_PIXELS) -> DataFrame:
    """Target objects and those met by the prediction, all and small ones."""
    parts = R.pixel_components(pred.where("target > 0").select(*key, "row", "col", "predicted"), key)
    objects = parts.groupBy(*key, "component").agg(
        F.count("*").alias("_n"), (F.count_if(F.col("predicted") > 0) / F.count("*") >= overlap).alias("_hit"))
    little = F.col("_n") <= small
    return objects.groupBy(*by).agg(
        F.count("*").alias("objects"), F.count_if("_hit").alias("detected"),
        F.count_if(little).alias("small_objects"), F.count_if(little & F.col("_hit")).alias("small_detected"))


def object_recall(pred: DataFrame, key: R.Key, by: list[str], **cfg) -> DataFrame:
    counts = object_counts(pred, key, by, **cfg)
    every = pred.select(*by).distinct() if by else counts
    joined = every.join(counts, by, "left") if by else counts
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        *by, ratio(zero("detected"), zero("objects")).alias("object_recall"),
        ratio(zero("small_detected"), zero("small_objects")).alias("small_object_recall"))


def log_loss(pred: DataFrame, sample: str) -> DataFrame:
    """Mean over samples of the mean pixel log loss."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("probability")))
    t = F.col("target")
    per = pred.groupBy(sample).agg(F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("_l"))
    return per.agg(F.avg("_l").alias("log_loss"))


# ---------------------------------------------------------------- change

def tier_of(score: Column, off_nadir: Column) -> Column:
    return (
        F.when(off_nadir | (score < K.TIER_MEDIUM), "difficult").when(score < K.TIER_HIGH, "medium").otherwise("high")
    )


def change_counts(pred: DataFrame, pairs: DataFrame, key: R.Key = ("pair_id",)) -> DataFrame:
    """Everything the change metrics need, one row per pair (and method).

    ``pred``: key, row, col, predicted and target labels on the full grid. ``pairs``: pair_id,
    pixel_area, tier. Target objects and predicted objects are found in one component pass.
    """
    k = list(key)
    p, t = F.col("predicted"), F.col("target")
    base = pred.groupBy(*k).agg(
        F.count("*").alias("pixels"),
        F.count_if((p > 0) & (t > 0)).alias("tp"), F.count_if((p > 0) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t > 0)).alias("fn"),
        (F.count_if(p.isin(*_ADDED)) - F.count_if(t.isin(*_ADDED))).alias("_da"),
        (F.count_if(p.isin(*_REMOVED)) - F.count_if(t.isin(*_REMOVED))).alias("_dr"))
    sides = F.explode(F.array_compact(F.array(
        F.when(t > 0, F.struct(F.lit("target").alias("side"), (p > 0).cast("int").alias("other"))),
        F.when(p > 0, F.struct(F.lit("predicted").alias("side"), (t > 0).cast("int").alias("other"))))))
    marks = pred.where((p > 0) | (t > 0)).select(*k, "row", "col", sides.alias("_s")).select(
        *k, "row", "col", "_s.side", "_s.other")
    parts = R.pixel_components(marks, (*key, "side")).groupBy(*k, "side", "component").agg(
        F.avg("other").alias("_share"))
    is_target = F.col("side") == "target"
    objects = parts.groupBy(*k).agg(
        F.count_if(is_target).alias("objects"),
        F.count_if(is_target & (F.col("_share") >= K.OBJECT_OVERLAP)).alias("detected"),
        F.count_if(~is_target & (F.col("_share") == 0)).alias("false_alarms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    area = F.col("pixel_area")
    return base.join(objects, k, "left").join(pairs.select("pair_id", "pixel_area", "tier"), "pair_id").select(
        *k, "tier", "tp", "fp", "fn", zero("objects"), zero("detected"), zero("false_alarms"),
        (F.col("fp") * area).alias("fp_area"), (F.col("pixels") * area).alias("total_area"),
        (F.abs("_da") * area).alias("added_error"), (F.abs("_dr") * area).alias("removed_error"))


def change_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """Metrics from pair counts; ``by`` may be empty for one overall row."""
    names = ("tp", "fp", "fn", "objects", "detected", "false_alarms", "fp_area", "total_area", "added_error", "removed_error")
    sums = counts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    return _finish(sums)


def _finish(sums: DataFrame) -> DataFrame:
    return with_overlap_metrics(sums).withColumn("object_recall", ratio(F.col("detected"), F.col("objects"))).withColumn(
        "false_alarms_per_km2", ratio(F.col("false_alarms"), F.col("total_area") / 1e6, 0.0))


def metrics_by_tier(counts: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per registration tier and overall (tier ``*``), in one aggregation."""
    names = ("tp", "fp", "fn", "objects", "detected", "false_alarms", "fp_area", "total_area", "added_error", "removed_error")
    sets = [[*(F.col(b) for b in by), F.col("tier")], [F.col(b) for b in by]]
    sums = counts.groupingSets(sets, *by, "tier").agg(*[F.sum(n).alias(n) for n in names])
    return _finish(sums.withColumn("tier", F.coalesce("tier", F.lit("*"))))


def compare_methods(predictions: dict[str, DataFrame], truth: DataFrame, pairs: DataFrame, split: str) -> DataFrame:
    """Methods on the identical pairs of one evaluation split, per tier and overall.

    ``predictions``: sparse labels (pair_id, row, col, label) per method; ``truth``: the full grid
    with target. Only the chosen split is read further.
    """
    if split not in ("validation", "test"):
        raise ValueError("change evaluation is limited to validation or test splits")
    chosen = pairs.where(F.col("split") == split)
    grid = truth.join(chosen.select("pair_id"), "pair_id", "left_semi").select("pair_id", "row", "col", "target")
    labels = None
    for method, df in predictions.items():
        part = df.select(F.lit(method).alias("method"), "pair_id", "row", "col", F.col("label").alias("_p"))
        labels = part if labels is None else labels.unionByName(part)
    methods = F.explode(F.array(*[F.lit(m) for m in predictions])).alias("method")
    pred = cut_lineage(
        grid.select("*", methods).join(labels, ["method", "pair_id", "row", "col"], "left")
        .select("method", "pair_id", "row", "col", F.coalesce("_p", F.lit(0)).alias("predicted"), "target"))
    return metrics_by_tier(change_counts(pred, chosen, ("method", "pair_id")), ["method"])


# ---------------------------------------------------------------- training

def _logit(width: int, weights: list[float], bias: float) -> Column:
    """Score of a row. The weights stand in an array literal, which compiled code takes as data: every epoch runs the same code."""
    xs = F.array(*[F.col(f"x{i}") for i in range(width)], F.col("one"))
    terms = F.zip_with(xs, F.lit([*map(float, weights), float(bias)]), lambda x, w: x * w)
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def _log_loss_terms(p: Column) -> Column:
    q, t = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p)), F.col("target")
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def _epoch(table: DataFrame, width: int, weights: list[float], bias: float, row_weight: Column, sums: dict | None = None) -> dict:
    """One job: the gradient's sums g0.. and g over rows weighted by ``row_weight``, and ``sums`` over the columns p and loss."""
    rows = table.withColumn("p", logistic(_logit(width, weights, bias)))
    rows = rows.select("*", ((F.col("p") - F.col("target")) * row_weight).alias("err"), _log_loss_terms(F.col("p")).alias("loss"))
    return rows.agg(
        *[F.sum(F.col("err") * F.col(f"x{i}")).alias(f"g{i}") for i in range(width)], F.sum("err").alias("g"),
        *[F.sum(c).alias(name) for name, c in (sums or {}).items()]).first().asDict()


def _compressed(features: DataFrame, width: int, extra: list[str], weights: dict[str, Column]) -> DataFrame:
    """Equal feature rows as one row with counts; exact, because the loss only sums over rows.

    Band values have 8 bits, so even a huge pixel table shrinks to its distinct value tuples, and
    every epoch reads the short table.
    """
    xs = [f"x{i}" for i in range(width)]
    return cut_lineage(features.groupBy(*xs, "target", *extra).agg(*[w.alias(n) for n, w in weights.items()], F.lit(1.0).alias("one")))


def train_logistic(features: DataFrame, width: int, rate: float = K.SIAMESE["rate"], epochs: int = K.SIAMESE["epochs"]) -> dict:
    """Full-batch logistic descent with positives weighted by negatives over positives.

    ``features``: x0..x{width-1} in 0..1 and a 0/1 target. Only the weights come to the driver.
    """
    table = _compressed(features, width, [], {"n": F.count("*")})
    total = table.agg(F.sum(F.when(F.col("target") > 0, F.col("n"))).alias("p"),
                      F.sum(F.when(F.col("target") == 0, F.col("n"))).alias("q")).first()
    if not total["p"] or not total["q"]:
        raise ValueError("training needs changed and unchanged pixels")
    heavy = total["q"] / total["p"]
    row_weight = F.col("n") * F.when(F.col("target") > 0, heavy).otherwise(1.0)
    denominator = total["q"] + heavy * total["p"]
    w, b = [0.0] * width, 0.0
    for _ in range(epochs):
        g = _epoch(table, width, w, b, row_weight)
        w = [wi - rate * g[f"g{i}"] / denominator for i, wi in enumerate(w)]
        b -= rate * g["g"] / denominator
    return {"weights": w, "bias": b, "positive_weight": heavy}


def siamese_features(pixels: DataFrame, bands: int = 3) -> DataFrame:
    xs = difference_features(bands)
    return pixels.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], (F.col("target") > 0).cast("int").alias("target"))


def train_segmentation(pixels: DataFrame, bands: list[str], rate: float = K.SEGMENTATION["rate"],
                       epochs: int = K.SEGMENTATION["epochs"], patience: int = K.SEGMENTATION["patience"],
                       min_delta: float = K.SEGMENTATION["min_delta"]) -> dict:
    """Logistic baseline on normalised bands, stopped early on the validation loss.

    ``pixels``: sample, split, bands, target. Normalisation comes from the training split. The
    batch is the whole split, so the result does not depend on row order.
    """
    from landshift.operators.curate import channel_stats

    stats = channel_stats(pixels.where("split = 'train'"), bands).first()
    mean, std = [stats[f"{b}_mean"] for b in bands], [stats[f"{b}_std"] for b in bands]
    if mean[0] is None:
        raise ValueError("training split is empty")
    sized = pixels.where(F.col("split").isin("train", "validation"))
    per_sample = sized.groupBy("sample").agg((1.0 / F.count("*")).alias("_share"))
    xs = [((F.col(b) / 255.0 - m) / s).alias(f"x{i}") for i, (b, m, s) in enumerate(zip(bands, mean, std))]
    rows = sized.join(per_sample, "sample").select(*xs, "target", "split", "_share")
    table = _compressed(rows, len(bands), ["split"], {"n": F.count("*"), "share": F.sum("_share")})
    counts = {r["split"]: (r["n"], r["s"]) for r in table.groupBy("split").agg(
        F.sum("n").alias("n"), F.sum("share").alias("s")).collect()}
    if len(counts) < 2:
        raise ValueError("training and validation splits are both required")
    w, b = [0.0] * len(bands), 0.0
    best, kept, waited, history = math.inf, (w, b), 0, []
    train, share = F.col("split") == "train", F.col("loss") * F.col("share")
    sums = {"t": F.when(train, share), "v": F.when(~train, share)}
    n = counts["train"][0]
    # The losses after an epoch and the next epoch's gradient belong to the same weights and come from one job.
    found = _epoch(table, len(bands), w, b, F.when(train, F.col("n")), sums)
    for _ in range(epochs):
        w = [wi - rate * found[f"g{i}"] / n for i, wi in enumerate(w)]
        b -= rate * found["g"] / n
        found = _epoch(table, len(bands), w, b, F.when(train, F.col("n")), sums)
        history.append((found["t"] / counts["train"][1], found["v"] / counts["validation"][1]))
        if history[-1][1] < best - min_delta:
            best, kept, waited = history[-1][1], (w, b), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return {"weights": kept[0], "bias": kept[1], "mean": mean, "std": std, "history": history}
