"""Ranking metrics from distinct scores and their counts, and precision-recall curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.functions.scalar import edge_bin, linspace, safe_div


def auc_summary(px: DataFrame, keys) -> DataFrame:
    """keys, roc_auc (ties count half), average_precision, auc_status; null values where one class is missing.

    Distinct scores are added up within ranges of a thousandth, and the ranges' totals before them, so that no window holds all scores of a group.
    """
    g = px.groupBy(*keys, "p").agg(F.sum("y").cast("double").alias("w"), F.sum(1 - F.col("y")).cast("double").alias("l"))
    g = g.withColumn("_range", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("p"))) * 1000).cast("int"))
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy(*keys, "_range").agg(F.sum("w").alias("_w"), F.sum("l").alias("_l"))
    zero = F.lit(0.0)
    totals = totals.select(
        *keys, "_range", F.coalesce(F.sum("_w").over(before), zero).alias("_bw"), F.coalesce(F.sum("_l").over(before), zero).alias("_bl"), F.sum("_w").over(Window.partitionBy(*keys)).alias("tw"))
    own = g.withColumn("cw", F.sum("w").over(down)).withColumn("cl", F.sum("l").over(down))
    g = own.join(totals, [*keys, "_range"]).select(*keys, "w", "l", (F.col("cw") + F.col("_bw")).alias("cw"), (F.col("cl") + F.col("_bl")).alias("cl"), "tw")
    sums = g.groupBy(*keys).agg(
        F.sum(F.col("l") * (F.col("cw") - F.col("w")) + F.col("l") * F.col("w") / 2).alias("area"), F.max("tw").alias("tw"), F.sum("l").alias("tl"),
        F.sum(F.try_divide("w", "tw") * F.try_divide(F.col("cw"), F.col("cw") + F.col("cl"))).alias("ap"))
    two = (F.col("tw") > 0) & (F.col("tl") > 0)
    return sums.select(
        *keys, F.round(F.when(two, F.try_divide(F.col("area"), F.col("tw") * F.col("tl"))), 9).alias("roc_auc"), F.round(F.when(two, F.col("ap")), 9).alias("average_precision"),
        F.when(two, "success").otherwise("undefined_single_class_reference").alias("auc_status"))


def summary_by_model(per_pair: DataFrame, model: str, metrics=("roc_auc", "average_precision"), status: str = "auc_status") -> DataFrame:
    """Pairs of each model, those whose areas are defined, and the spread of the areas over these."""
    from gridmetric.operators.metrics import describe

    return per_pair.groupBy(model).agg(F.count("*").alias("n_pairs"), F.count_if(F.col(status) == "success").alias("n_success_pairs"), *describe(metrics))


def score_range(px: DataFrame, keys, p: str) -> DataFrame:
    """Least, greatest and mean score of each group; NaN doesn't count."""
    real = F.when(~F.isnan(p), F.col(p))
    return px.groupBy(*keys).agg(F.min(real).alias("score_min"), F.max(real).alias("score_max"), F.round(F.avg(real), 9).alias("score_mean"))


def score_curves(px: DataFrame, keys, bins: int = 1000) -> DataFrame:
    """keys, bin, tp, fp: scores at or above each edge, among positives and negatives; scores outside 0-1 don't count."""
    edges = linspace(0.0, 1.0, bins + 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int")))
    e = F.array(*map(F.lit, edges))
    at = F.when(F.col("p") < F.get(e, guess), guess - 1).when((F.col("p") >= F.get(e, guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    inside = px.where((F.col("p") >= 0) & (F.col("p") <= 1))
    hist = inside.groupBy(*keys, at.cast("int").alias("bin")).agg(F.sum("y").cast("long").alias("w"), F.sum(1 - F.col("y")).cast("long").alias("l"))
    return curves_of(hist, keys, bins)


def curves_of(hist: DataFrame, keys, bins: int) -> DataFrame:
    """The same from counts of positives and negatives in each bin (keys, bin, w, l)."""
    spine = hist.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(hist, [*keys, "bin"], "left").fillna(0, ["w", "l"])
    up = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*keys, "bin", F.sum("w").over(up).alias("tp"), F.sum("l").over(up).alias("fp"))


def trapezoid(points: DataFrame, keys, x: str, y: str, order, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = points.withColumn("area", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return steps.groupBy(*keys).agg(F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 9).alias(name))


def auc_pr(curves: DataFrame, keys) -> DataFrame:
    """Area of the pooled precision-recall curve by recall; equal recalls go by falling bin."""
    total = F.max("tp").over(Window.partitionBy(*keys))
    points = curves.select(*keys, "bin", safe_div("tp", total).alias("recall"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"))
    return trapezoid(points, keys, "recall", "precision", ["recall", F.desc("bin")], "auc_pr")


def pr_curve(sweep: DataFrame, keys) -> DataFrame:
    """Points of a sweep: greatest precision at each recall; without predictions precision is 1 and recall 0."""
    none = (F.col("tp") == 0) & (F.col("fp") == 0)
    points = sweep.select(*keys, F.when(none, 0.0).otherwise(F.col("recall")).alias("recall"), F.when(none, 1.0).otherwise(F.col("precision")).alias("precision"))
    return points.groupBy(*keys, "recall").agg(F.max("precision").alias("precision"))


def pr_curve_ap(sweep: DataFrame, keys) -> DataFrame:
    return trapezoid(pr_curve(sweep, keys), keys, "recall", "precision", ["recall"], "pr_ap")


def histogram(df: DataFrame, keys, p: str, edges: list[float]) -> DataFrame:
    """Counts in right-open bins by their edges, the last closed."""
    return df.withColumn("bin", edge_bin(p, edges)).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
