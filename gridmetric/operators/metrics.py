"""Confusion counts and the metrics on them, with both rules for empty denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.functions.scalar import safe_div

COUNTS = ("tn", "fp", "fn", "tp")
METRICS = ("oa", "f1", "precision", "recall", "iou", "mcc")


def confusion_counts(df: DataFrame, keys, y: Column, predicted: Column) -> DataFrame:
    hit = lambda a, b, name: F.count_if((y == a) & (predicted == b)).alias(name)
    return df.groupBy(*keys).agg(hit(0, 0, "tn"), hit(0, 1, "fp"), hit(1, 0, "fn"), hit(1, 1, "tp"))


def binary_metrics(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, Column]:
    """Evaluator rule: 0 where a denominator is empty, but null for oa. Counts go to double before they are multiplied."""
    tn, fp, fn, tp = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (tn, fp, fn, tp))
    return {
        "oa": safe_div(tp + tn, tp + tn + fp + fn, None), "f1": safe_div(2 * tp, 2 * tp + fp + fn), "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn), "iou": safe_div(tp, tp + fp + fn), "mcc": safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def ensemble_metrics(fp="fp", fn="fn", tp="tp") -> dict[str, Column]:
    """Ensemble rule: null iou on an empty union, 0 for precision and recall."""
    m = binary_metrics(F.lit(0), *(F.col(x) if isinstance(x, str) else x for x in (fp, fn, tp)))
    f, n, t = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (fp, fn, tp))
    return {"iou": safe_div(t, t + f + n, None), "precision": m["precision"], "recall": m["recall"]}


def with_columns(df: DataFrame, columns: dict[str, Column], digits: int | None = 9) -> DataFrame:
    return df.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in columns.items()})


def macro_scores(df: DataFrame, keys, y: str, predicted: str, classes: int = 2, ignore: int = 255) -> DataFrame:
    """Macro mIoU and F1 over classes, and the confusion matrix flat (CM_i_j), from counts of (y, predicted)."""
    cell = lambda i, j: F.sum(F.when((F.col(y) == i) & (F.col(predicted) == j), 1).otherwise(0))
    cells = df.where(F.col(y) != ignore).groupBy(*keys).agg(*(cell(i, j).cast("long").alias(f"CM_{i}_{j}") for i in range(classes) for j in range(classes)))
    iou, f1 = [], []
    for k in range(classes):
        tp = F.col(f"CM_{k}_{k}")
        wrong = sum((F.col(f"CM_{k}_{j}") + F.col(f"CM_{j}_{k}") for j in range(classes) if j != k), F.lit(0))
        iou.append(safe_div(tp, tp + wrong))
        f1.append(safe_div(2 * tp, 2 * tp + wrong))
    mean = lambda xs: F.round(sum(xs[1:], xs[0]) / classes, 9)
    return cells.select("*", mean(iou).alias("miou"), mean(f1).alias("macro_f1"))


def describe(metrics, ci: bool = False, spread: bool = True, digits: int = 9) -> list[Column]:
    """mean, sample std, min and max of each metric, or mean, std and the 2.5 and 97.5 percentiles; nulls are left out."""
    out = []
    for m in metrics:
        out += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_samp(m), digits).alias(f"{m}_std")]
        if ci:
            out += [F.round(F.percentile(m, F.lit(0.025)), digits).alias(f"{m}_ci_low"), F.round(F.percentile(m, F.lit(0.975)), digits).alias(f"{m}_ci_high")]
        if spread:
            out += [F.round(F.min(m), digits).alias(f"{m}_min"), F.round(F.max(m), digits).alias(f"{m}_max")]
    return out


def percentiles(df: DataFrame, keys, value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the interpolated percentile of each share: from counts of equal values, which a window adds up in order of value.

    Unlike the aggregate function, no group's values are all in memory at once. Null and NaN don't count; a group without any other has no row.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("_stop", F.sum("_n").over(w.orderBy(value))).withColumn("_total", F.sum("_n").over(w))
    at = lambda place: F.max(F.when((F.col("_stop") - F.col("_n") <= place) & (place < F.col("_stop")), F.col(value)))
    out, names = [], []
    for name, share in shares.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        out += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
        names.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")).alias(name))
    return c.groupBy(*keys).agg(*out).select(*keys, *names)


def metric_groups(per_scene: DataFrame, keys, metrics=METRICS) -> DataFrame:
    """Scenes of each group and the spread of their metrics; null keys are a group."""
    return per_scene.groupBy(*keys).agg(F.count("*").alias("n_scenes"), *describe(metrics))


def pair_summary(per_scene: DataFrame, keys, metrics=METRICS) -> DataFrame:
    """One row a pair: the mean is the value, std and interval are null."""
    empty = F.lit(None).cast("double")
    return per_scene.select(*keys, *(c for m in metrics for c in (F.col(m).alias(f"{m}_mean"), empty.alias(f"{m}_std"), empty.alias(f"{m}_ci_low"), empty.alias(f"{m}_ci_high"))))


def model_from_pairs(pairs: DataFrame, model: str = "model_name", pair: str = "scene", metrics=METRICS, pixels: str = "n_pixels") -> DataFrame:
    """Macro summary of pair means: pairs, pixels in all, and the spread over pairs."""
    return pairs.groupBy(model).agg(F.count_distinct(pair).alias("n_pairs"), F.sum(pixels).cast("long").alias("total_pixels"), *describe(metrics, ci=True))
