"""Calibration from a mergeable fine histogram: reliability tables, ECE, MCE, Brier score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.functions.scalar import fine_bin, linspace


def fine_histogram(px: DataFrame, keys, bins: int = 1000) -> DataFrame:
    """keys, bin, n, pos, sum_p: partial sums that merge by adding."""
    return px.groupBy(*keys, fine_bin("p", bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"), F.sum("p").alias("sum_p"))


def merge(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("sum_p").alias("sum_p"))


def brier(px: DataFrame, keys) -> DataFrame:
    """n, prevalence, mean score and Brier score from running moments."""
    s = lambda x: F.sum(x)
    return px.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("prevalence"), F.round(F.avg("p"), 9).alias("mean_p"),
        F.round((s(F.col("p") * F.col("p")) - 2 * s(F.col("p") * F.col("y")) + s(F.col("y"))) / F.count("*"), 9).alias("brier"))


def quantile_edges(fine: DataFrame, keys, coarse: int, bins: int = 1000) -> DataFrame:
    """keys, edge (fine-bin number): about equal mass between edges, snapped to fine bins, equal edges once."""
    w = Window.partitionBy(*keys)
    cum = fine.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("cum"), F.sum("n").over(w).alias("total"))
    targets = cum.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(coarse - 1))))
    inner = targets.where(F.col("cum") * coarse >= F.col("k") * F.col("total")).groupBy(*keys, "k").agg((F.min("bin") + 1).alias("edge")).select(*keys, "edge")
    ends = fine.select(*keys).distinct().withColumn("edge", F.explode(F.array(F.lit(0), F.lit(bins))))
    return inner.unionByName(ends).distinct()


def coarse_table(fine: DataFrame, keys, edges: DataFrame | list[float], bins: int = 1000) -> DataFrame:
    """keys, bin_left, bin_right, n, mean_pred, obs_freq: fine bins put together by their left edge; empty bins have null rates.

    edges: a list in 0-1 for all groups, or a table (keys, edge) in fine-bin numbers.
    """
    if isinstance(edges, list):
        spans = fine.select(*keys).distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("bin_left"), F.lit(b).alias("bin_right")) for a, b in zip(edges, edges[1:])]))).select(*keys, "s.*")
        at = F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("bin") / bins >= e)) - 1, F.lit(len(edges) - 2))
        placed = fine.withColumn("bin_left", F.get(F.array(*map(F.lit, edges)), at))
    else:
        nxt = Window.partitionBy(*keys).orderBy("edge")
        spans = edges.select(*keys, (F.col("edge") / bins).alias("bin_left"), (F.lead("edge").over(nxt) / bins).alias("bin_right")).where(F.col("bin_right").isNotNull())
        # The greatest edge at or below each fine bin, by one ordered pass over both.
        both = fine.select(*keys, "bin", "n", "pos", "sum_p", F.lit(1).alias("is_bin")).unionByName(edges.select(*keys, F.col("edge").alias("bin"), F.lit(0).alias("is_bin")), allowMissingColumns=True)
        run = Window.partitionBy(*keys).orderBy("bin", "is_bin")
        placed = both.withColumn("bin_left", F.last(F.when(F.col("is_bin") == 0, F.col("bin") / bins), True).over(run)).where("is_bin = 1")
    sums = placed.groupBy(*keys, "bin_left").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("sum_p").alias("sum_p"))
    out = spans.join(sums, [*keys, "bin_left"], "left").fillna(0, ["n"])
    return out.select(*keys, F.round("bin_left", 9).alias("bin_left"), F.round("bin_right", 9).alias("bin_right"), "n", F.round(F.try_divide("sum_p", "n"), 9).alias("mean_pred"), F.round(F.try_divide("pos", "n"), 9).alias("obs_freq"))


def ece_mce(coarse: DataFrame, keys) -> DataFrame:
    """Expected and maximum calibration error over bins with pixels."""
    gap = F.abs(F.col("obs_freq") - F.col("mean_pred"))
    return coarse.where("n > 0").groupBy(*keys).agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 8).alias("ece"), F.round(F.max(gap), 8).alias("mce"))


def fixed_edges(coarse: int) -> list[float]:
    return linspace(0.0, 1.0, coarse + 1)
