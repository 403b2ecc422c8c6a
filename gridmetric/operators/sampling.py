"""Samples of exact size by hash order, and the bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def subsample(df: DataFrame, keys, ids, k: int, seed: int = 42, order=None) -> DataFrame:
    """At most k rows of each group, by the order of a hash of ids, or of another column of hashes, then of ids.

    Hashes of ids are counted by their leading bits first, so that only the ranges that hold the k least of a group are put in order.
    """
    if order is None:
        dealt = df.withColumn("_hash", F.xxhash64(F.lit(seed), *ids)).withColumn("_bin", F.shiftright("_hash", 52))
        own = {x: f"_k{i}" for i, x in enumerate(keys)}
        counts = dealt.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumnsRenamed({**own, "_bin": "_b"})
        before = F.sum("_n").over(Window.partitionBy(*own.values()).orderBy("_b")) - F.col("_n")
        needed = counts.withColumn("_before", before).where(F.col("_before") < k).drop("_n", "_before")
        same = F.col("_bin") == F.col("_b")
        for x, name in own.items():
            same = same & F.col(x).eqNullSafe(F.col(name))
        df, order = dealt.join(needed, same, "left_semi").drop("_bin"), F.col("_hash")
    w = Window.partitionBy(*keys).orderBy(order, *ids)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= k).drop("_nth", "_hash")


def seeded_shuffle(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Rows with their place from 1 in an order that depends on the seed and a whole-number key alone: arithmetic that is alike in every engine."""
    from gridmetric.operators.ranking import rank_all

    # Fixed values of the generator: two multipliers and a prime.
    draw = F.pmod(F.pmod(F.col(key) * 7919 + F.lit(seed), F.lit(2147483647)) * 48271, F.lit(2147483647))
    return rank_all(df.withColumn("_draw", draw), ("_draw", key), name).drop("_draw")


def sorted_subset(df: DataFrame, keys, ratio: float, hash_column, top: int, bins: int = 1000) -> DataFrame:
    """The int(n * ratio) rows least by a hash from 0 to top (excluded), then by keys: a sample without replacement of exact size.

    Counts of hash bins name the bin in which the last row lies; bins before it go in whole, and only that bin is put in order.
    """
    width = -(-top // bins)
    rows = df.withColumn("_bin", F.floor(hash_column / width).cast("int"))
    counts = sorted(rows.groupBy("_bin").count().collect())
    left, border = int(sum(c["count"] for c in counts) * ratio), -1
    for c in counts:
        border = c["_bin"]
        if left <= c["count"]:
            break
        left -= c["count"]
    whole = rows.where(F.col("_bin") < border)
    last = rows.where(F.col("_bin") == border).withColumn("_nth", F.row_number().over(Window.partitionBy("_bin").orderBy(hash_column, *keys)))
    return whole.unionByName(last.where(F.col("_nth") <= left).drop("_nth")).drop("_bin")


def bootstrap(pixels: DataFrame, keys, replicates: int, size: int, seed: int = 42) -> DataFrame:
    """keys, rep, tn, fp, fn, tp of `replicates` draws of `size` pixels with replacement.

    pixels: keys and code (1 TP, 2 FP, 3 FN, 4 TN). Only the four counts matter, so pixels become cumulative counts once and each draw is a number
    below n that falls into one of four ranges. The draw is arithmetic, (a * rep + b * draw + seed) mod a prime mod n, alike in every engine.
    """
    count = lambda k: F.count_if(F.col("code") == k)
    totals = pixels.groupBy(*keys).agg(count(1).alias("c1"), count(2).alias("c2"), count(3).alias("c3"), F.count_if(F.col("code") > 0).alias("n"))
    totals = totals.withColumn("n", F.when(F.col("n") >= size, F.col("n")).otherwise(F.raise_error(F.lit("sample is larger than the pool")).cast("long")))
    reps = totals.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # Fixed values of the generator: two multipliers and a prime.
    draws = reps.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    x = draws.withColumn("x", F.expr(f"(((CAST(rep AS BIGINT) * 7919 + CAST(draw AS BIGINT) * 104729 + {seed}) * 48271) % 2147483647) * 16807 % 2147483647 % n"))
    hit = lambda low, high: F.count_if((F.col("x") >= low) & (F.col("x") < high))
    a, b, c = F.col("c1"), F.col("c1") + F.col("c2"), F.col("c1") + F.col("c2") + F.col("c3")
    return x.groupBy(*keys, "rep").agg(hit(F.lit(0), a).alias("tp"), hit(a, b).alias("fp"), hit(b, c).alias("fn"), hit(c, F.col("n")).alias("tn"))


def bootstrap_counts(counts: DataFrame, keys, replicates: int, size: int | None = None, seed: int = 42) -> DataFrame:
    """keys, rep, tn, fp, fn, tp of `replicates` draws of `size` pixels with replacement (None: as many as the key has), from one row of counts a key.

    A replicate is a multinomial draw, split into three binomial ones, so that its cost doesn't depend on the sample's size. Its generator is counted by
    the seed, a hash of the keys and the replicate's number: the draws are the same however rows are dealt, and distinct for every replicate.
    """
    names = ("tp", "fp", "fn", "tn")
    n = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    wanted = n if size is None else F.when(n >= size, F.lit(size)).otherwise(F.raise_error(F.lit("sample is larger than the pool")).cast("long"))
    own = counts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("long").alias(c) for c in names], wanted.cast("long").alias("m"), F.xxhash64(*keys).alias("h"))
    reps = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    heads = [f"k{i}" for i in range(len(keys))]
    schema = StructType([*[own.schema[k] for k in heads], *StructType.fromDDL("rep int, tn long, fp long, fn long, tp long").fields])

    def draw(batches):
        for batch in batches:
            c = np.stack([batch.column(x).to_numpy() for x in names])
            total, found = c.sum(axis=0), np.zeros((4, batch.num_rows), np.int64)
            for row, (h, rep, m) in enumerate(zip(batch.column("h").to_pylist(), batch.column("rep").to_pylist(), batch.column("m").to_pylist())):
                rng = np.random.Generator(np.random.Philox(key=[seed, h & (2**64 - 1)], counter=[0, 0, 0, rep]))
                left, pool = m, int(total[row])
                for k in range(3):
                    here = int(rng.binomial(left, min(1.0, c[k, row] / pool))) if pool and left else 0
                    found[k, row], left, pool = here, left - here, pool - int(c[k, row])
                found[3, row] = left
            tp, fp, fn, tn = (pa.array(x) for x in found)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in heads], batch.column("rep"), tn, fp, fn, tp], names=schema.names)

    return reps.mapInArrow(draw, schema).withColumnsRenamed(dict(zip(heads, keys)))


def bootstrap_summary(samples: DataFrame, keys, metrics) -> DataFrame:
    from gridmetric.operators.metrics import describe

    return samples.groupBy(*keys).agg(F.count("*").alias("n_reps"), *describe(metrics, ci=True, spread=False))


def kde(df: DataFrame, keys, x: str, grid: list[float], least: int = 100, steps: int = 32) -> DataFrame:
    """keys, at, density: Gaussian kernels with Scott's bandwidth on a fixed grid; groups of fewer than `least` rows are left out.

    Rows are binned linearly in steps of 1/steps of the bandwidth, each shared by the two ends of its step, and the kernel is summed over bins: work is
    rows + bins x grid. A density is off by 1 / (8 steps ** 2) of a kernel's peak at most (1.2e-4 with 32), as a kernel's second derivative is at most
    its peak over the squared bandwidth. Sums of the shares, not the shares, are shuffled.
    """
    good = df.where(F.col(x).isNotNull() & ~F.isnan(x))
    stats = good.groupBy(*keys).agg(F.count("*").alias("_n"), F.stddev_samp(x).alias("_s")).where((F.col("_n") >= least) & (F.col("_s") > 0))
    stats = stats.select(*keys, "_n", (F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))
    at = F.col(x) * steps / F.col("_h")
    steps_of = good.join(stats, list(keys)).groupBy(*keys, "_n", "_h", F.floor(at).alias("_b")).agg(F.count("*").alias("_w"), F.sum(at - F.floor(at)).alias("_f"))
    ends = F.explode(F.array(F.struct(F.col("_b").alias("b"), (F.col("_w") - F.col("_f")).alias("w")), F.struct((F.col("_b") + 1).alias("b"), F.col("_f").alias("w"))))
    bins = steps_of.select(*keys, "_n", "_h", ends.alias("_e")).groupBy(*keys, "_n", "_h", F.col("_e.b").alias("_b")).agg(F.sum("_e.w").alias("_w"))
    on_grid = bins.withColumn("at", F.explode(F.array(*map(F.lit, grid))))
    z = F.col("at") / F.col("_h") - F.col("_b") / steps
    return on_grid.groupBy(*keys, "at").agg(F.round(F.sum(F.col("_w") * F.exp(-z * z / 2)) / F.max(F.col("_n") * F.col("_h") * 2.5066282746310002), 9).alias("density"))


def kde2(df: DataFrame, keys, x: str, y: str, grid_x: list[float], grid_y: list[float], least: int = 100, steps: int = 32) -> DataFrame:
    """keys, at_x, at_y, density: Gaussian kernels with Scott's factor on the covariance.

    Binned as kde, along both axes, in steps of 1/steps of the kernel's width along an axis with the other held fixed, its least width. A density is off
    by 1 / (4 steps ** 2) of a kernel's peak at most. A cell's four shares follow from its count and three sums.
    """
    good = df.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y))
    stats = good.groupBy(*keys).agg(F.count("*").alias("_n"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy")).where(F.col("_n") >= least)
    stats = stats.withColumn("_f2", F.pow(F.col("_n").cast("double"), F.lit(-1 / 3))).withColumn("_det", F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")).where("_det > 0")
    step = lambda other: F.sqrt(F.col("_det") * F.col("_f2") / F.col(other)) / steps
    stats = stats.withColumn("_dx", step("_yy")).withColumn("_dy", step("_xx"))
    of = [c for c in stats.columns if c.startswith("_")]
    u, v = F.col(x) / F.col("_dx"), F.col(y) / F.col("_dy")
    fu, fv = u - F.floor(u), v - F.floor(v)
    cells = good.join(stats, list(keys)).groupBy(*keys, *of, F.floor(u).alias("_i"), F.floor(v).alias("_j"))
    cells = cells.agg(F.count("*").alias("_w"), F.sum(fu).alias("_u"), F.sum(fv).alias("_v"), F.sum(fu * fv).alias("_uv"))
    share = lambda a, b, w: F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), w.alias("w"))
    w, su, sv, uv = (F.col(c) for c in ("_w", "_u", "_v", "_uv"))
    corners = F.explode(F.array(share(0, 0, w - su - sv + uv), share(1, 0, su - uv), share(0, 1, sv - uv), share(1, 1, uv)))
    bins = cells.select(*keys, *of, corners.alias("_c")).groupBy(*keys, *of, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).agg(F.sum("_c.w").alias("_w"))
    points = F.explode(F.array(*[F.struct(F.lit(a).alias("at_x"), F.lit(b).alias("at_y")) for a in grid_x for b in grid_y]))
    g = bins.withColumn("_g", points).withColumn("at_x", F.col("_g.at_x")).withColumn("at_y", F.col("_g.at_y"))
    dx, dy = F.col("at_x") - F.col("_i") * F.col("_dx"), F.col("at_y") - F.col("_j") * F.col("_dy")
    q = (dx * dx * F.col("_yy") - 2 * dx * dy * F.col("_xy") + dy * dy * F.col("_xx")) / (F.col("_det") * F.col("_f2"))
    return g.groupBy(*keys, "at_x", "at_y").agg(F.round(F.sum(F.col("_w") * F.exp(-q / 2)) / F.max(F.col("_n") * 6.283185307179586 * F.sqrt("_det") * F.col("_f2")), 9).alias("density"))
