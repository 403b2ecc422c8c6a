"""Ranks, paired comparisons and summaries of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_rows(df: DataFrame, by, order, name: str = "rank") -> DataFrame:
    """Row numbers from 1 within groups, or over all rows where by is empty (see rank_all)."""
    if not by:
        return rank_all(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rank_all(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Row numbers from 1 over all rows, of which no task has all.

    Rows are dealt by ranges of the order and written; each range counts its own, and the ranges before it give its first number.
    """
    from gridmetric.sources.shared import scratch_folder

    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(first), "_range").withColumn(name, (F.col("_first") + own).cast("int")).drop("_range", "_first")


#: Rows for a task that sorts them, and ranges of the order for each such task.
ROWS, RANGES = 1 << 19, 4


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def deal(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df dealt by the keys so that a task has about ROWS of so many rows, whatever the session's number of shuffle partitions; where one task would do,
    Spark decides. Tables dealt by the same number of rows meet without a further exchange."""
    n = tasks_for(rows)
    return df if n == 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def number_within(df: DataFrame, group: Column, order, name: str, ranges: int = 256) -> DataFrame:
    """Row numbers from 0 within groups, of which no task has a whole one; the first column of the order is a number, nulls first.

    Rows are dealt by ranges of that column, alike in all groups; each range of a group counts its own, and the ranges before it give its first
    number. Where ranges end (approximate quantiles) decides how even they are, never a number. Rows that are equal in the first column stay together.
    There are `ranges` or more, as many as the rows' tasks need, so that neither a range nor a task grows with the input.
    """
    from pyspark.ml.feature import Bucketizer

    key, rows = F.col(order[0]).cast("double"), df.count()
    ranges = max(ranges, RANGES * tasks_for(rows))
    at = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("at")).first().at or [0.0]
    ends = [float("-inf"), *sorted(set(at)), float("inf")]
    keyed = df.withColumn("_group", group).withColumn("_key", F.coalesce(key, F.lit(float("-inf"))))
    dealt = Bucketizer(splits=ends, inputCol="_key", outputCol="_range").transform(keyed).drop("_key").withColumn("_range", F.col("_range").cast("int"))  # rows dealt by a float are dealt again
    counts = dealt.groupBy("_group", "_range").agg(F.count("*").alias("_n"))  # a row a range at most
    first = counts.select("_group", "_range", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")).alias("_first"))
    first = first.withColumnsRenamed({"_group": "_g", "_range": "_r"})
    own = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order))
    numbered = deal(dealt, rows, "_group", "_range").withColumn("_own", own).join(F.broadcast(first), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return numbered.withColumn(name, F.col("_first") + F.col("_own") - 1).drop("_group", "_range", "_g", "_r", "_first", "_own")


def model_ranking(pairs: DataFrame, model: str, value: str, pixels: str, metadata: DataFrame) -> DataFrame:
    """model, n_pairs, total_pixels, the spread of the value, the metadata's columns (null for a model it lacks) and the rank by mean.

    There is a row a model, so ranking them is small; ties go by name and rows without a mean come last.
    """
    r = lambda x, n: F.round(x, 9).alias(f"{value}_{n}")
    s = pairs.groupBy(model).agg(
        F.count(value).alias("n_pairs"), F.sum(pixels).cast("long").alias("total_pixels"), r(F.avg(value), "mean"), r(F.percentile(value, F.lit(0.5)), "median"),
        r(F.stddev_samp(value), "std"), r(F.min(value), "min"), r(F.max(value), "max"), r(F.percentile(value, F.lit(0.025)), "ci_low"), r(F.percentile(value, F.lit(0.975)), "ci_high"))
    joined = s.join(metadata, s[model].eqNullSafe(metadata[model]), "left").drop(metadata[model])
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(f"{value}_mean"), model)))


def interval_means(log: DataFrame, step: str, value: str, every: int) -> DataFrame:
    """interval, n and mean of the value over each `every` steps."""
    return log.groupBy(F.floor(F.col(step) / every).alias("interval")).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def common_pairs(first: DataFrame, second: DataFrame, name: str, order: str) -> DataFrame:
    """Names that both configurations have, in the order of the first."""
    return first.join(second.select(name).distinct(), name, "left_semi").select(name, order)


def near_threshold(rows: DataFrame, wanted: DataFrame, threshold: str = "threshold", step: float = 0.01) -> DataFrame:
    """Rows at the wanted thresholds, met as whole steps, so that sums of floating-point steps are equal to their literals."""
    index = lambda c: F.round(F.col(c) / step).cast("int")
    return rows.withColumn("_t", index(threshold)).join(wanted.select(index(threshold).alias("_t")).distinct(), "_t", "left_semi").drop("_t")


def top_k(df: DataFrame, by, order, k: int) -> DataFrame:
    return rank_rows(df, by, order).where(F.col("rank") <= k)


def median_ci(df: DataFrame, keys, value: str) -> DataFrame:
    r = lambda x, n: F.round(x, 9).alias(f"{value}_{n}")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.avg(value), "mean"), r(F.percentile(value, F.lit(0.5)), "median"), r(F.stddev_samp(value), "std"), r(F.min(value), "min"), r(F.max(value), "max"),
        r(F.percentile(value, F.lit(0.025)), "ci_low"), r(F.percentile(value, F.lit(0.975)), "ci_high"))


def paired_deltas(df: DataFrame, pair, preset: str, baseline: str, value: str, by) -> DataFrame:
    """Differences from the baseline preset on equal pairs, summed up by group; the baseline itself is left out."""
    base = df.where(F.col(preset) == baseline).select(*pair, F.col(value).alias("_base"))
    d = df.where(F.col(preset) != baseline).join(base, list(pair)).withColumn("delta", F.col(value) - F.col("_base"))
    return d.groupBy(*by).agg(F.count("*").alias("n_pairs"), *(F.round(f("delta"), 11).alias(f"delta_{n}") for f, n in ((F.avg, "mean"), (F.median, "median"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))), F.count_if(F.col("delta") > 0).alias("n_better"))


def suffix_gain(df: DataFrame, by, preset: str, suffix: str, value: str) -> DataFrame:
    """by, preset, base and suffixed values, gain: rows whose preset is another row's with the suffix."""
    base = df.select(*by, F.col(preset).alias("base_preset"), F.col(value).alias("base_value"), F.concat(preset, F.lit(suffix)).alias("_key"))
    more = df.select(*by, F.col(preset).alias("_key"), F.col(value).alias("suffixed_value"))
    return base.join(more, [*by, "_key"]).drop("_key").withColumn("gain", F.round(F.col("suffixed_value") - F.col("base_value"), 9))


def running_best(df: DataFrame, by, order, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w))


def cumulative_suffix(df: DataFrame, by, bin_: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(bin_)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("suffix_sum", F.sum(value).over(w))


def contiguous_interval(df: DataFrame, by, index: str, flag: str, anchor: str) -> DataFrame:
    """by, low, high: the run of true flags around the anchor's index. The anchor is always in it; without a true flag it is alone."""
    i, a = F.col(index), F.col(anchor)
    g = df.groupBy(*by).agg(
        F.max(anchor).alias("_a"), F.bool_or(F.coalesce(flag, F.lit(False))).alias("_any"), F.min(index).alias("_first"), F.max(index).alias("_last"),
        F.max(F.when((i < a) & ~F.coalesce(flag, F.lit(False)), i)).alias("_below"), F.min(F.when((i > a) & ~F.coalesce(flag, F.lit(False)), i)).alias("_above"))
    low = F.when(F.col("_any"), F.coalesce(F.col("_below") + 1, "_first")).otherwise(F.col("_a"))
    high = F.when(F.col("_any"), F.coalesce(F.col("_above") - 1, "_last")).otherwise(F.col("_a"))
    return g.select(*by, low.alias("low"), high.alias("high"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def study_pivot(trials: DataFrame, states: list[str], study: str = "study_name", state: str = "state", value: str = "value", complete: str = "COMPLETE") -> DataFrame:
    """Trials of each study by state, and the best value of the complete ones."""
    counts = [F.count_if(F.col(state) == s).alias(s) for s in states]
    return trials.groupBy(study).agg(F.count("*").alias("n_trials"), *counts, F.max(F.when(F.col(state) == complete, F.col(value))).alias("best_value"))


def group_success(manifest: DataFrame, keys, status: str = "status", code: str = "return_code") -> DataFrame:
    """A group succeeded if every status did and every return code is 0 or null."""
    ok = F.bool_and(F.col(status) == "success") & F.bool_and(F.coalesce(F.col(code) == 0, F.lit(True)))
    return manifest.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(ok, F.lit(False)).alias("success"))


def preset_compatibility(checkpoints: DataFrame, presets: DataFrame) -> DataFrame:
    """checkpoint x preset with input size, compatible and reason.

    checkpoints: checkpoint, allowed (array or null), max_size (or null); presets: preset, tile_size (or null), buffer_size (null: 0).
    """
    x = checkpoints.crossJoin(presets).withColumn("input_size", F.col("tile_size") + 2 * F.coalesce("buffer_size", F.lit(0)))
    reason = F.when(F.col("allowed").isNotNull() & ~F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), F.col("preset")), "not_in_allowed_presets").when(F.col("input_size") > F.col("max_size"), "input_too_large").otherwise("")
    return x.withColumn("reason", reason).withColumn("compatible", F.col("reason") == "")


def threshold_lookup(rows: DataFrame, thresholds: DataFrame, on) -> DataFrame:
    """Rows with their threshold and a status for those without one."""
    j = rows.join(thresholds, list(on), "left")
    return j.withColumn("status", F.when(F.col("threshold").isNull(), "skipped_no_loo_threshold").otherwise("success"))


def missing_predictions(wanted: DataFrame, present: DataFrame, on, fail: bool = False) -> DataFrame:
    """Wanted rows with status success or missing_prediction; with fail, a missing one is an error when evaluated."""
    j = wanted.join(present.select(*on, F.lit(True).alias("_has")).distinct(), list(on), "left")
    missing = F.raise_error(F.lit("missing prediction")).cast("string") if fail else F.lit("missing_prediction")
    return j.withColumn("status", F.when(F.col("_has"), "success").otherwise(missing)).drop("_has")


def sanity_gate(measured: DataFrame, expected: DataFrame, on, value: str = "iou", tolerance: float = 2e-3) -> DataFrame:
    """on, least distance of any measured value to the expected one, and whether it is within the tolerance."""
    j = expected.withColumnRenamed(value, "_e").join(measured.withColumnRenamed(value, "_m"), list(on), "left")
    return j.groupBy(*on).agg(F.round(F.min(F.abs(F.col("_e") - F.col("_m"))), 9).alias("distance")).withColumn("ok", F.coalesce(F.col("distance") <= tolerance, F.lit(False)))
