"""Threshold sweeps from a histogram over the thresholds, best thresholds, and leave-one-scene-out selection.

The number of thresholds that a score passes decides every confusion count, so pixels are aggregated once to (group, passed) and no pixel is
compared with each threshold again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.operators.metrics import METRICS, binary_metrics, describe, with_columns


def passed(p: str, thresholds: list[float], comparison: str = "greater_than"):
    """How many of the ascending thresholds p passes. Even steps are found by arithmetic and corrected by the comparison itself."""
    n, col = len(thresholds), F.col(p)
    edges = F.array(*map(F.lit, thresholds))
    step = (thresholds[-1] - thresholds[0]) / max(1, n - 1)
    above = (lambda t: col > t) if comparison == "greater_than" else (lambda t: col >= t)
    if n > 2 and all(abs(thresholds[0] + i * step - t) < 1e-9 for i, t in enumerate(thresholds)):
        guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((col - thresholds[0]) / step).cast("int")))
        near = lambda k: F.when((guess + k >= 0) & (guess + k < n), F.when(above(F.get(edges, guess + k)), 1).otherwise(0)).otherwise(F.when(guess + k < 0, 1).otherwise(0))
        count = guess - 1 + near(-1) + near(0) + near(1)
    else:
        count = F.size(F.filter(edges, above))
    return F.when(col.isNull() | F.isnan(col), 0).otherwise(count).cast("int")


def score_histogram(px: DataFrame, keys, thresholds, comparison: str = "greater_than") -> DataFrame:
    """keys, b (thresholds passed), pos, neg."""
    return px.groupBy(*keys, passed("p", thresholds, comparison).alias("b")).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def threshold_sweep(px: DataFrame, keys, thresholds, comparison: str = "greater_than") -> DataFrame:
    """keys, t_idx, threshold, tn, fp, fn, tp and the metrics at each threshold."""
    hist = score_histogram(px, keys, thresholds, comparison)
    n = len(thresholds)
    spine = hist.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n))))
    full = spine.join(hist, [*keys, "b"], "left").fillna(0, ["pos", "neg"])
    group = Window.partitionBy(*keys)
    above = group.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    counts = full.select(*keys, "b", over("pos", above).alias("tp"), over("neg", above).alias("fp"), over("pos", group).alias("pos"), over("neg", group).alias("neg"))
    # Threshold i is passed by scores that pass more than i thresholds.
    at = counts.where(F.col("b") < n).select(*keys, F.col("b").alias("t_idx"), F.get(F.array(*map(F.lit, thresholds)), F.col("b")).alias("threshold"), (F.col("neg") - F.col("fp")).alias("tn"), "fp", (F.col("pos") - F.col("tp")).alias("fn"), "tp")
    return with_columns(at, binary_metrics())


def naive_sweep(px: DataFrame, keys, thresholds, comparison: str = "greater_than") -> DataFrame:
    """The same by comparing every pixel with every threshold; the yardstick of the tests and the benchmark."""
    grid = px.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]))).select(*keys, "y", "p", "t.*")
    hit = (F.col("p") > F.col("threshold")) if comparison == "greater_than" else (F.col("p") >= F.col("threshold"))
    q = F.when(~F.isnan("p") & hit, 1).otherwise(0)
    count = lambda a, b, name: F.count_if((F.col("y") == a) & (q == b)).alias(name)
    return with_columns(grid.groupBy(*keys, "t_idx", "threshold").agg(count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn"), count(1, 1, "tp")), binary_metrics())


def sweep_summary(sweep: DataFrame, model="model_name", metrics=METRICS) -> DataFrame:
    """Macro over scenes at each threshold."""
    return sweep.groupBy(model, "t_idx", "threshold").agg(F.count("*").alias("n_pairs"), *describe(metrics, spread=False))


def _long(df: DataFrame, keys, metrics, suffix: str) -> DataFrame:
    stack = ", ".join(f"'{m}', {m}{suffix}" for m in metrics)
    return df.selectExpr(*keys, f"stack({len(metrics)}, {stack}) AS (metric, value)").where(F.col("value").isNotNull() & ~F.isnan("value"))


def best_threshold(summary: DataFrame, model="model_name", metrics=("iou", "f1", "mcc")) -> DataFrame:
    """Threshold of the greatest macro mean for each model and metric; ties go to the lowest threshold."""
    rank = Window.partitionBy(model, "metric").orderBy(F.desc("value"), "t_idx")
    rows = _long(summary, (model, "t_idx", "threshold"), metrics, "_mean")
    return rows.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def loo_threshold(sweep: DataFrame, model="model_name", scene="scene", metrics=("iou", "f1", "mcc")) -> DataFrame:
    """For each held-out scene the threshold of the best mean over the other scenes, with the held-out value there.

    The mean of the others comes from sums, so scenes are not joined with each other; models with one scene are left out.
    """
    rows = _long(sweep, (model, scene, "t_idx", "threshold"), metrics, "")
    group = Window.partitionBy(model, "metric", "t_idx")
    others = rows.withColumn("n", F.count("*").over(group)).withColumn("total", F.sum("value").over(group)).where("n > 1")
    mean = F.round((F.col("total") - F.col("value")) / (F.col("n") - 1), 12)
    rank = Window.partitionBy(model, "metric", scene).orderBy(F.desc("train_mean"), "t_idx")
    chosen = others.withColumn("train_mean", mean).withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return chosen.select(model, F.col(scene).alias("held_out"), "metric", "t_idx", "threshold", "train_mean", F.col("value").alias("held_out_value"))


def loo_summary(loo: DataFrame, model="model_name") -> DataFrame:
    return loo.groupBy(model, "metric").agg(F.count("*").alias("n_scenes"), *describe(("held_out_value",)), *describe(("threshold",), spread=False))
