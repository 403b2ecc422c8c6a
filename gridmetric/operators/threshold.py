"""Choice of a threshold: equivalence tests against the peak, risk-adjusted optima, and a recommendation.

Input: by (keys), pair, t_idx, threshold, value: one metric of each pair at each threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.functions.scalar import format_interval, format_signed
from gridmetric.functions.student import t_cdf, t_ppf
from gridmetric.operators.ranking import contiguous_interval

#: What a recommendation rests on, with and without an intersection of both intervals.
JUSTIFICATIONS = ("TOST+low-var intersection", "risk-adjusted (no intersection)")


def curve(rows: DataFrame, by) -> DataFrame:
    """by, t_idx, threshold, mean, std (one pair: 0), n."""
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "t_idx", "threshold").agg(F.round(F.avg("value"), 12).alias("mean"), F.coalesce(F.round(F.stddev_samp("value"), 12), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def peak(curve_: DataFrame, by) -> DataFrame:
    """by, peak_idx, peak_threshold, peak_mean: the greatest mean, the lowest threshold of equal ones."""
    w = Window.partitionBy(*by).orderBy(F.desc("mean"), "t_idx")
    return curve_.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, F.col("t_idx").alias("peak_idx"), F.col("threshold").alias("peak_threshold"), F.col("mean").alias("peak_mean"))


def _differences(rows: DataFrame, by, peaks: DataFrame) -> DataFrame:
    """Per pair and threshold: the peak's value less the value."""
    with_peak = rows.join(peaks, list(by))
    w = Window.partitionBy(*by, "pair")
    return with_peak.withColumn("_d", F.max(F.when(F.col("t_idx") == F.col("peak_idx"), F.col("value"))).over(w) - F.col("value"))


def tost(rows: DataFrame, by, delta: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """by, t_idx, threshold, p_lower, p_upper, equivalent, skipped.

    Two one-sided t-tests of the paired differences from the peak within delta, alpha shared among the other thresholds; the peak is equivalent,
    and with fewer than five pairs all are.
    """
    peaks = peak(curve(rows, by), by)
    g = _differences(rows, by, peaks).groupBy(*by, "t_idx", "threshold", "peak_idx").agg(F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"), F.count("_d").alias("_n"))
    all_ = Window.partitionBy(*by)
    se = F.col("_s") / F.sqrt("_n")
    t = lambda shift: F.when(se > 0, (F.col("_m") + shift) / se).otherwise(F.when(F.col("_m") + shift > 0, float("inf")).when(F.col("_m") + shift < 0, float("-inf")).otherwise(0.0))
    df = (F.col("_n") - 1).cast("double")
    p = g.withColumn("skipped", F.max("_n").over(all_) < 5).withColumn("_cut", F.lit(alpha) / F.greatest(F.count("*").over(all_) - 1, F.lit(1)))
    p = p.withColumn("p_lower", t_cdf(t(-delta), df)).withColumn("p_upper", 1 - t_cdf(t(delta), df))
    at_peak = F.col("t_idx") == F.col("peak_idx")
    value = lambda c: F.when(F.col("skipped"), None).when(at_peak, 1.0).otherwise(F.round(c, 9)).alias(c)
    ok = F.col("skipped") | at_peak | ((F.col("p_lower") < F.col("_cut")) & (F.col("p_upper") < F.col("_cut")))
    return p.select(*by, "t_idx", "threshold", value("p_lower"), value("p_upper"), ok.alias("equivalent"), "skipped", "peak_idx")


def tost_interval(tested: DataFrame, by) -> DataFrame:
    return contiguous_interval(tested, by, "t_idx", "equivalent", "peak_idx")


def risk_adjusted(curve_: DataFrame, by, lambdas=(0.5, 1.0, 2.0)) -> DataFrame:
    """by, lambda, t_idx, threshold, risk: argmax of mean - lambda * std, the lowest threshold of equal ones."""
    x = curve_.withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas)))).withColumn("risk", F.round(F.col("mean") - F.col("lambda") * F.col("std"), 9))
    w = Window.partitionBy(*by, "lambda").orderBy(F.desc("risk"), "t_idx")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "lambda", "t_idx", "threshold", "risk")


def low_cv_interval(curve_: DataFrame, by) -> DataFrame:
    """by, low, high (t_idx): run around the peak where std / mean is at or below its 25th percentile; null where the mean isn't positive."""
    cv = F.when(F.col("mean") > 0, F.round(F.col("std") / F.col("mean"), 9))
    x = curve_.withColumn("cv", cv)
    cut = x.groupBy(*by).agg(F.percentile("cv", F.lit(0.25)).alias("_cut"))
    flagged = x.join(cut, list(by)).join(peak(curve_, by), list(by)).withColumn("flag", F.col("cv") <= F.round(F.col("_cut"), 9))
    return contiguous_interval(flagged, by, "t_idx", "flag", "peak_idx")


def recommend(rows: DataFrame, by, delta: float = 0.01, alpha: float = 0.05, default: float = 0.5) -> DataFrame:
    """One row a group: the best mean inside both intervals, else the risk-adjusted optimum at 1; and the default's comparison with the peak."""
    c = curve(rows, by)
    peaks, tested = peak(c, by), tost(rows, by, delta, alpha)
    a = tost_interval(tested, by).select(*by, F.col("low").alias("tost_low"), F.col("high").alias("tost_high"))
    b = low_cv_interval(c, by).select(*by, F.col("low").alias("lv_low"), F.col("high").alias("lv_high"))
    x = c.join(a, list(by)).join(b, list(by))
    inside = (F.col("t_idx") >= F.greatest("tost_low", "lv_low")) & (F.col("t_idx") <= F.least("tost_high", "lv_high"))
    best = F.max(F.when(inside, F.struct("mean", (-F.col("t_idx")).alias("neg"), "threshold"))).alias("best")
    at = lambda i, name: F.max(F.when(F.col("t_idx") == F.col(i), F.col("threshold"))).alias(name)
    first = F.min(F.when(F.col("threshold") >= default - 1e-12, F.struct("t_idx", "threshold", "mean"))).alias("_d")
    picked = x.groupBy(*by).agg(best, at("tost_low", "tost_low_t"), at("tost_high", "tost_high_t"), at("lv_low", "lv_low_t"), at("lv_high", "lv_high_t"), first)
    risk = risk_adjusted(c, by, (1.0,)).select(*by, F.col("t_idx").alias("risk_idx"), F.col("threshold").alias("risk_t"))
    base = picked.join(peaks, list(by)).join(risk, list(by)).join(c.select(*by, F.col("t_idx").alias("risk_idx"), F.col("mean").alias("risk_mean")), [*by, "risk_idx"])
    diffs = _differences(rows, by, peaks).join(picked.select(*by, F.col("_d.t_idx").alias("t_idx")), [*by, "t_idx"]).groupBy(*by).agg(
        F.count_if(F.col("_d") > 0).alias("n_pos"), F.count("_d").alias("_n"), F.avg("_d").alias("_m"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("_se"))
    half = F.when(F.col("_n") > 1, t_ppf(F.lit(0.975), (F.col("_n") - 1).cast("double")) * F.col("_se")).otherwise(0.0)
    found = F.col("best").isNotNull()
    out = base.join(diffs.withColumn("_half", half), list(by))
    mean = F.coalesce("best.mean", "risk_mean")
    return out.select(
        *by, "peak_threshold", "peak_mean", F.coalesce("best.threshold", "risk_t").alias("recommended_t"), mean.alias("recommended_mean"), F.round(F.col("peak_mean") - mean, 9).alias("loss_vs_peak"),
        format_interval("tost_low_t", "tost_high_t").alias("tost_interval"), format_interval("lv_low_t", "lv_high_t").alias("low_var_interval"), found.alias("intersection_found"),
        F.when(found, JUSTIFICATIONS[0]).otherwise(JUSTIFICATIONS[1]).alias("justification"),
        F.lit(default).between(F.col("tost_low_t"), F.col("tost_high_t")).alias("default_in_tost"), F.round(F.col("peak_mean") - F.col("_d.mean"), 4).alias("loss_at_default"),
        F.concat_ws("/", F.col("n_pos").cast("string"), F.col("_n").cast("string")).alias("sign_consistency"),
        F.concat(format_signed("_m"), F.lit(" ["), format_signed(F.col("_m") - F.col("_half")), F.lit(", "), format_signed(F.col("_m") + F.col("_half")), F.lit("]")).alias("mean_signed_diff"))
