"""Ensembles from error patterns.

One aggregation turns pixels into (scene, y, pred_mask, n), at most 2 * 2**members rows a scene. Votes, oracle, overlaps of errors and
subset searches are functions of that table, so their cost doesn't depend on the number of pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridmetric.functions.scalar import linspace, threshold_probability
from gridmetric.operators.auc import curves_of
from gridmetric.operators.metrics import ensemble_metrics, with_columns
from gridmetric.sources.shared import Tables


def pattern_table(wide: DataFrame, scores: list[str], thresholds=0.5, keys=("scene",), comparison: str = "greater_than") -> DataFrame:
    """keys, y, pred_mask (bit k: member k says water), n."""
    cuts = thresholds if isinstance(thresholds, (list, tuple)) else [thresholds] * len(scores)
    mask = sum((threshold_probability(s, t, comparison).cast("long") * F.lit(1 << k) for k, (s, t) in enumerate(zip(scores, cuts))), F.lit(0).cast("long"))
    return wide.groupBy(*keys, "y", mask.alias("pred_mask")).agg(F.count("*").alias("n"))


def error_mask(n_members: int, pred: str = "pred_mask", y: str = "y") -> Column:
    """Bits of the members that are wrong."""
    full = (1 << n_members) - 1
    return F.when(F.col(y) == 1, F.lit(full).bitwiseXOR(F.col(pred))).otherwise(F.col(pred)).cast("long")


def majority(mask: Column, k) -> Column:
    """Half of the k members or more say water, so an even tie is water."""
    return 2 * F.bit_count(mask) >= k


def _counts(says: Column) -> list[Column]:
    n, wet = F.col("n"), F.col("y") == 1
    return [F.sum(F.when(c, n).otherwise(0)).cast("long").alias(name) for name, c in (("tp", says & wet), ("fp", says & ~wet), ("fn", ~says & wet))]


def vote(patterns: DataFrame, members: int, n_members: int, keys=()) -> DataFrame:
    """Counts and metrics of the majority of the members in a bit mask."""
    k = bin(members).count("1")
    out = patterns.groupBy(*keys).agg(*_counts(majority(F.col("pred_mask").bitwiseAND(F.lit(members)), k)))
    return with_columns(out, ensemble_metrics())


def oracle_bound(patterns: DataFrame, n_members: int, keys=()) -> DataFrame:
    """Counts and metrics if a pixel is right wherever any member is."""
    any_right = error_mask(n_members) != (1 << n_members) - 1
    says = F.when(any_right, F.col("y") == 1).otherwise(F.col("y") == 0)
    return with_columns(patterns.groupBy(*keys).agg(*_counts(says)), ensemble_metrics())


def exhaustive_votes(patterns: DataFrame, n_members: int, least: int = 1) -> DataFrame:
    """subset (bit mask), k, counts and metrics of the majority of every subset."""
    pooled = patterns.groupBy("y", "pred_mask").agg(F.sum("n").alias("n"))
    subsets = pooled.withColumn("subset", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << n_members) - 1).cast("long")))).withColumn("k", F.bit_count("subset")).where(F.col("k") >= least)
    says = majority(F.col("pred_mask").bitwiseAND(F.col("subset")), F.col("k"))
    return with_columns(subsets.groupBy("subset", "k").agg(*_counts(says)), ensemble_metrics())


def composition(subset: str, groups: dict[str, int]) -> dict[str, Column]:
    """Members of each group in a subset, and the groups' names joined."""
    counts = {f"n_{g.lower()}": F.bit_count(F.col(subset).bitwiseAND(F.lit(m))) for g, m in groups.items()}
    names = F.array_compact(F.array(*[F.when(F.col(subset).bitwiseAND(F.lit(m)) != 0, g) for g, m in sorted(groups.items())]))
    return {**counts, "composition": F.array_join(names, "+")}


def best_per(votes: DataFrame, by: str) -> DataFrame:
    """Row of the greatest iou in each group; ties go to the least subset."""
    w = Window.partitionBy(by).orderBy(F.desc("iou"), "subset")
    return votes.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def micro_macro(patterns: DataFrame, members: int, n_members: int, scene: str = "scene") -> DataFrame:
    """Pooled iou, and the mean of the scenes' ious."""
    per_scene = vote(patterns, members, n_members, (scene,))
    pooled = per_scene.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.round(F.avg("iou"), 9).alias("macro_iou"))
    return with_columns(pooled, {"micro_iou": ensemble_metrics()["iou"]})


def pairwise_errors(patterns: DataFrame, n_members: int, kind: str = "any") -> DataFrame:
    """a, b, errors of each and of both, Jaccard, and P(a errs given b errs), for all ordered pairs; kind: any, fp or fn."""
    rows = patterns if kind == "any" else patterns.where(F.col("y") == (0 if kind == "fp" else 1))
    err = rows.select(error_mask(n_members).alias("e"), "n").groupBy("e").agg(F.sum("n").alias("n"))
    pair = F.explode(F.expr(f"flatten(transform(sequence(0, {n_members - 1}), a -> transform(sequence(0, {n_members - 1}), b -> struct(a, b))))"))
    x = err.select("e", "n", pair.alias("m")).select("n", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.getbit("e", F.col("m.a")).alias("ea"), F.getbit("e", F.col("m.b")).alias("eb"))
    s = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long").alias(name)
    out = x.groupBy("a", "b").agg(s(F.col("ea") == 1, "n_a"), s(F.col("eb") == 1, "n_b"), s((F.col("ea") == 1) & (F.col("eb") == 1), "n_both"))
    return out.withColumn("jaccard", F.round(F.try_divide(F.col("n_both").cast("double"), F.col("n_a") + F.col("n_b") - F.col("n_both")), 9)).withColumn("cond", F.round(F.try_divide(F.col("n_both").cast("double"), "n_b"), 9))


def multiplicity(patterns: DataFrame, n_members: int, keys=(), kind: str = "any") -> DataFrame:
    """Pixels by how many members are wrong on them, 0 ... n; of one class for fp and fn."""
    rows = patterns if kind == "any" else patterns.where(F.col("y") == (0 if kind == "fp" else 1))
    got = rows.groupBy(*keys, F.bit_count(error_mask(n_members)).alias("n_wrong")).agg(F.sum("n").alias("n"))
    one = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    spine = one.withColumn("n_wrong", F.explode(F.sequence(F.lit(0), F.lit(n_members))))
    return spine.join(got, [*keys, "n_wrong"], "left").fillna(0, ["n"])


def shared_errors(patterns: DataFrame, n_members: int) -> DataFrame:
    """Pixels on which any or all members err, the share that all share, and the share that some member could mend."""
    e = error_mask(n_members)
    s = patterns.agg(F.sum(F.when(e != 0, F.col("n")).otherwise(0)).cast("long").alias("n_any"), F.sum(F.when(e == (1 << n_members) - 1, F.col("n")).otherwise(0)).cast("long").alias("n_all"))
    return s.withColumn("shared", F.round(F.try_divide(F.col("n_all").cast("double"), "n_any"), 9)).withColumn("recoverable", F.round(1 - F.try_divide(F.col("n_all").cast("double"), "n_any"), 9))


def mechanism_jaccard(pairs: DataFrame, mechanism_of: list[str]) -> DataFrame:
    """Mean Jaccard of the pairs a < b by their two mechanisms."""
    names = F.array(*map(F.lit, mechanism_of))
    x, y = F.get(names, F.col("a")), F.get(names, F.col("b"))
    return pairs.where("a < b").groupBy(F.least(x, y).alias("m1"), F.greatest(x, y).alias("m2")).agg(F.count("*").alias("n_pairs"), F.round(F.avg("jaccard"), 9).alias("mean_jaccard"))


def greedy_selection(patterns: DataFrame, n_members: int) -> list[dict]:
    """Forward selection from the best single member by pooled iou; ties take the larger number. One small job a step."""
    pooled = patterns.groupBy("y", "pred_mask").agg(F.sum("n").alias("n")).persist()
    chosen, log = 0, []
    try:
        while chosen != (1 << n_members) - 1:
            steps = [chosen | (1 << m) for m in range(n_members) if not chosen >> m & 1]
            tried = pooled.withColumn("subset", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])))
            says = majority(F.col("pred_mask").bitwiseAND(F.col("subset")), F.bit_count("subset"))
            rows = with_columns(tried.groupBy("subset").agg(*_counts(says)), ensemble_metrics()).collect()
            best = max(rows, key=lambda r: (-1 if r.iou is None else r.iou, r.subset))
            log.append({"step": len(log) + 1, "added": (best.subset ^ chosen).bit_length() - 1, "subset": best.subset, "iou": best.iou})
            chosen = best.subset
    finally:
        pooled.unpersist()
    return log


def naive_votes(wide: DataFrame, scores: list[str]) -> DataFrame:
    """The exhaustive vote search on single pixels, each met by every subset: what the pattern table saves. For comparison only."""
    subsets = F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << len(scores)) - 1).cast("long"))).alias("subset")
    mask = sum((F.when(threshold_probability(s, 0.5) == 1, 1 << k).otherwise(0) for k, s in enumerate(scores)), F.lit(0)).cast("long")
    x = wide.select("y", mask.alias("pred_mask"), F.lit(1).alias("n"), subsets)
    says = majority(F.col("pred_mask").bitwiseAND(F.col("subset")), F.bit_count("subset"))
    return with_columns(x.groupBy("subset").agg(*_counts(says)), ensemble_metrics())


def soft_mean(wide: DataFrame, scores: list[str], keys=("scene", "y")) -> DataFrame:
    """keys and p, the mean of the members' scores."""
    return wide.select(*keys, (sum((F.col(s) for s in scores[1:]), F.col(scores[0])) / len(scores)).alias("p"))


def soft_candidates(n_members: int, groups: list[int]) -> list[int]:
    """Bit masks: every subset of two or more within a group, every pair, and all members."""
    inside = {s for g in groups for s in range(1, 1 << n_members) if s & g == s and bin(s).count("1") >= 2}
    pairs = {1 << a | 1 << b for a in range(n_members) for b in range(a)}
    return sorted(inside | pairs | {(1 << n_members) - 1})


def mean_of(subset: int) -> Callable[[np.ndarray], np.ndarray]:
    """Mean of a bit mask's members, from a matrix of scores, one row a member; members are added in order, as SQL adds them."""
    own = [k for k in range(subset.bit_length()) if subset >> k & 1]

    def mean(scores: np.ndarray) -> np.ndarray:
        total = scores[own[0]].copy()
        for k in own[1:]:
            total += scores[k]
        return total / len(own)

    return mean


def weighted_mean_of(a: int, b: int, w10: int) -> Callable[[np.ndarray], np.ndarray]:
    """Mean of two members with a weight of w10 tenths for the first."""
    return lambda scores: (scores[a] * w10 + scores[b] * (10 - w10)) / 10


def edge_bins(bins: int) -> Callable[[np.ndarray], np.ndarray]:
    """Bin of each score as auc.score_curves has it: the last of `bins` even edges from 0 that it reaches; -1 outside 0-1."""
    edges = np.array(linspace(0.0, 1.0, bins + 1))

    def at(p: np.ndarray) -> np.ndarray:
        inside = (p >= 0) & (p <= 1)
        p = np.where(inside, p, 0.0)
        guess = np.clip(np.floor(p * bins).astype(np.int64), 0, bins - 1)
        up = (p >= edges[guess + 1]) & (guess < bins - 1)
        return np.where(inside, np.where(p < edges[guess], guess - 1, guess + up), -1)

    return at


def above(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """1 for scores beyond a threshold, 0 for others, NaN among them."""
    return lambda p: (p > threshold).astype(np.int64)


def candidate_histograms(wide: DataFrame, scores: list[str], candidates: dict[tuple, Callable[[np.ndarray], np.ndarray]], names: list[str], bin_of: Callable[[np.ndarray], np.ndarray], bins: int, keys=("scene",), y: str = "y", held: int = 64) -> DataFrame:
    """keys, names, bin, w, l: for each candidate the positive and the negative pixels in each bin of its scores, zeros left out.

    candidates: labels (values of the columns `names`, whole numbers) and a function from the members' scores to the candidate's. One pass over the
    pixels updates one array of counts a key, which holds a histogram for each candidate; no row is made for a pixel and candidate. A task sends its
    arrays when it has `held` keys, and at its end. Pixels with a null score count as NaN, which edge_bins leaves out.
    """
    labels, makers = list(candidates), list(candidates.values())
    own = [f"k{i}" for i in range(len(keys))]
    source = wide.select(*[F.col(k).alias(n) for k, n in zip(keys, own)], F.col(y).cast("int").alias("y"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
    schema = StructType([*[source.schema[n] for n in own], *StructType.fromDDL("candidate int, bin int, w long, l long").fields])

    def run(batches):
        counts: dict[tuple, np.ndarray] = {}

        def send():
            for key, c in counts.items():
                at = np.flatnonzero(c.any(axis=2))
                some = c.reshape(-1, 2)[at]
                cols = [pa.repeat(pa.scalar(v, source_types[n]), len(at)) for n, v in zip(own, key)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at // bins, pa.int32()), pa.array(at % bins, pa.int32()), pa.array(some[:, 1]), pa.array(some[:, 0])], names=schema.names)
            counts.clear()

        source_types = {}
        for batch in batches:
            source_types = {n: batch.schema.field(n).type for n in own}
            matrix = np.stack([pc.fill_null(batch.column(f"s{i}"), float("nan")).to_numpy(zero_copy_only=False) for i in range(len(scores))])
            positive = pc.fill_null(batch.column("y"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = pa.table({n: batch.column(n) for n in own}).append_column("row", pa.array(np.arange(batch.num_rows))).group_by(own).aggregate([("row", "list")]) if own else None
            rows = [((), np.arange(batch.num_rows))] if groups is None else [(tuple(r[n] for n in own), np.array(r["row_list"])) for r in groups.to_pylist()]
            for key, at in rows:
                some, one = matrix[:, at], positive[at]
                total = counts.setdefault(key, np.zeros((len(makers), bins, 2), np.int64))
                for c, make in enumerate(makers):
                    found = bin_of(make(some))
                    good = found >= 0
                    total[c] += np.bincount(found[good] * 2 + one[good], minlength=2 * bins).reshape(bins, 2)
            if len(counts) >= held:
                yield from send()
        yield from send()

    sums = source.mapInArrow(run, schema).groupBy(*own, "candidate", "bin").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    label = lambda i: F.get(F.array(*[F.lit(x[i]) for x in labels]), F.col("candidate"))
    return sums.select(*[F.col(n).alias(k) for k, n in zip(keys, own)], *[label(i).alias(n) for i, n in enumerate(names)], "bin", "w", "l")


def soft_counts(wide: DataFrame, scores: list[str], candidates: list[int], threshold: float = 0.5) -> DataFrame:
    """subset, tp, fp, fn of every candidate set's mean score at a threshold, in one pass over the pixels."""
    made = {(c,): mean_of(c) for c in candidates}
    counts = candidate_histograms(wide, scores, made, ["subset"], above(threshold), 2, keys=())
    at = lambda c, b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(c))), F.lit(0))
    return counts.groupBy(F.col("subset").cast("long").alias("subset")).agg(at("w", 1).alias("tp"), at("l", 1).alias("fp"), at("w", 0).alias("fn"))


def weighted_pair_curves(wide: DataFrame, scores: list[str], bins: int, keys=("scene",)) -> DataFrame:
    """keys, a, b, w10, bin, tp, fp: curves of the nine weighted means of every two members (w10: weight of a in tenths), in one pass."""
    n = len(scores)
    made = {(a, b, w): weighted_mean_of(a, b, w) for a in range(n) for b in range(a + 1, n) for w in range(1, 10)}
    names = ["a", "b", "w10"]
    return curves_of(candidate_histograms(wide, scores, made, names, edge_bins(bins), bins, keys), [*names, *keys], bins)


def loo_tuned(curves: DataFrame, keys=(), scene: str = "scene", macro: bool = False, joint: bool = False) -> DataFrame:
    """keys, held_out, chosen bin, and counts of the held-out scene there. With joint, the keys' values are chosen together with the bin.

    curves: keys, scene, bin, tp, fp (at or above the bin). micro picks the bin of the greatest pooled iou of the other scenes, macro that of the
    greatest mean of their ious; the first maximum wins.
    """
    pos = F.max("tp").over(Window.partitionBy(*keys, scene))
    c = curves.withColumn("fn", pos - F.col("tp"))
    iou = lambda t, f, n: F.try_divide(t.cast("double"), t + f + n)
    c = c.withColumn("iou", iou(F.col("tp"), F.col("fp"), F.col("fn")))
    group = Window.partitionBy(*keys, "bin")
    rest = lambda x: F.sum(x).over(group) - F.col(x)
    value = F.try_divide(F.sum("iou").over(group) - F.col("iou"), F.count("iou").over(group) - 1) if macro else iou(rest("tp"), rest("fp"), rest("fn"))
    best = Window.partitionBy(scene).orderBy(F.desc_nulls_last("train"), *keys, "bin") if joint else Window.partitionBy(*keys, scene).orderBy(F.desc_nulls_last("train"), "bin")
    ranked = c.withColumn("train", F.round(value, 9)).withColumn("rank", F.row_number().over(best))
    return ranked.where("rank = 1").select(*keys, F.col(scene).alias("held_out"), "bin", "tp", "fp", "fn", F.round("iou", 9).alias("iou"))


def consensus_errors(wide: DataFrame, scores: list[str], tuned: list[float], keys=("scene", "pix")) -> DataFrame:
    """Wrong members at their tuned thresholds and at 0.5, for each pixel, with all and all-but-two wrong."""
    wrong = lambda cuts: sum((F.when(threshold_probability(s, t) != F.col("y"), 1).otherwise(0) for s, t in zip(scores, cuts)), F.lit(0))
    n = len(scores)
    out = wide.select(*keys, "y", wrong(tuned).alias("n_wrong_tuned"), wrong([0.5] * n).alias("n_wrong_05"))
    return out.withColumn("all_wrong", F.col("n_wrong_tuned") == n).withColumn("most_wrong", F.col("n_wrong_tuned") >= n - 2)


def logistic_sums(rows: DataFrame, scores: list[str], own: str, held: list[int], weights: np.ndarray) -> dict[int, np.ndarray]:
    """For each held-out scene: loss, gradient and upper triangle of the Hessian of its logistic model, summed over all rows of the other scenes.

    own: column of a row's scene as a number; weights: a row a model, the intercept last. One pass serves all models; a task sends its sums, no rows. A null or
    infinite score is an error.
    """
    d = len(scores) + 1
    upper = np.triu_indices(d)
    source = rows.select(F.col(own).cast("int").alias("own"), F.col("y").cast("double").alias("y"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])

    def run(batches):
        sums = np.zeros((len(held), 1 + d + len(upper[0])))
        for batch in batches:
            x, y = np.ones((batch.num_rows, d)), batch.column("y").to_numpy(zero_copy_only=False)
            for i in range(d - 1):
                x[:, i] = pc.fill_null(batch.column(f"s{i}"), float("nan")).to_numpy(zero_copy_only=False)
            if not np.isfinite(x).all():
                raise ValueError("scores must be finite numbers")
            squares, scene = x[:, upper[0]] * x[:, upper[1]], batch.column("own").to_numpy()
            for at in range(0, len(held), 64):
                margin = x @ weights[at : at + 64].T
                other = scene[:, None] != np.array(held[at : at + 64])[None, :]
                small = np.exp(-np.abs(margin))
                p = np.where(margin >= 0, 1.0, small) / (1 + small)
                loss = np.maximum(margin, 0) - margin * y[:, None] + np.log1p(small)
                some = sums[at : at + 64]
                some[:, 0] += (loss * other).sum(axis=0)
                some[:, 1 : d + 1] += ((p - y[:, None]) * other).T @ x
                some[:, d + 1 :] += (small / (1 + small) ** 2 * other).T @ squares
        n = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), n), pa.int32()), pa.array(np.tile(np.arange(n), len(held)), pa.int32()), pa.array(sums.ravel())], names=["model", "at", "v"])

    found = source.mapInArrow(run, "model int, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v")).collect()  # some numbers a scene
    out = np.zeros((len(held), 1 + d + len(upper[0])))
    for r in found:
        out[r["model"], r["at"]] = r["v"]
    return dict(zip(held, out))


def logistic_models(rows: DataFrame, scores: list[str], own: str, counts: list[tuple[int, int]], c: float = 1.0, close: float = 1e-10, rounds: int = 100) -> list[np.ndarray]:
    """Weights, the intercept last, of a logistic regression for each scene, on all rows of the other scenes, with a penalty of weights ** 2 / (2 c).

    counts: rows and positive rows of each scene, in the order of the numbers in `own`. Each round of Newton's method is one pass for all scenes' models; a step
    that doesn't lessen the loss is halved. A model is done when a step would lessen the mean loss by less than `close`, and takes that step.
    """
    d = len(scores) + 1
    upper, penalty = np.triu_indices(d), np.array([1.0 / c] * (d - 1) + [0.0])
    n, positive = (sum(x) for x in zip(*counts)) if counts else (0, 0)
    models, left, last = [np.zeros(d) for _ in counts], [], {}
    for s, (own_n, own_positive) in enumerate(counts):
        train, good = n - own_n, positive - own_positive
        if not train:
            raise ValueError("no other scene to learn from")
        if 0 < good < train:
            left.append(s)
        else:  # one class alone
            models[s][-1] = np.inf if good else -np.inf
    while left:
        rounds -= 1
        if rounds < 0:
            raise ArithmeticError("logistic models didn't settle")
        for s, sums in logistic_sums(rows, scores, own, left, np.stack([models[s] for s in left])).items():
            w = models[s]
            loss = sums[0] + (penalty * w * w).sum() / 2
            if s in last and not loss <= last[s][0] * (1 + 1e-12):
                before, base, step = last[s]
                last[s] = (before, base, step / 2)
                models[s] = base + step / 2
                continue
            gradient, hessian = sums[1 : d + 1] + penalty * w, np.zeros((d, d))
            hessian[upper] = sums[d + 1 :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
            step = -np.linalg.solve(hessian, gradient)
            last[s], models[s] = (loss, w, step), w + step
            if -gradient @ step <= close * (n - counts[s][0]):
                left = [x for x in left if x != s]
    return models


def logistic_stacker(wide: DataFrame, scores: list[str], scene: str = "scene", c: float = 1.0) -> DataFrame:
    """scene, y, p of a logistic regression on the members' scores, trained on all rows of the other scenes, one model a scene.

    Labels, scores and scenes are stored once: a round and the result read them alone, and a score that is an expression isn't computed again wherever p is used.
    """
    spark = wide.sparkSession
    kept = Tables(spark, "stacker").keep(wide.select(scene, "y", *scores))
    label = lambda v: F.count_if(F.col("y").cast("double") == v)
    found = kept.groupBy(scene).agg(F.count("*").alias("n"), label(1).alias("positive"), label(0).alias("negative")).collect()  # a row a scene
    if any(r["n"] != r["positive"] + r["negative"] for r in found):
        raise ValueError("labels must be 0 or 1")
    at = StructType([StructField("_scene", wide.schema[scene].dataType), *StructType.fromDDL("_own int").fields])
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(found)], at)
    here = lambda x: kept.join(F.broadcast(x), F.col(scene).eqNullSafe(F.col("_scene")))
    models = logistic_models(here(numbers), scores, "_own", [(r["n"], r["positive"]) for r in found], c)
    fields = StructType([at["_scene"], *StructType.fromDDL("_intercept double, _weights array<double>").fields])
    fitted = spark.createDataFrame([(r[0], float(w[-1]), [float(x) for x in w[:-1]]) for r, w in zip(found, models)], fields)
    margin = sum((F.col(s) * F.get("_weights", F.lit(k)) for k, s in enumerate(scores)), F.lit(0.0)) + F.col("_intercept")
    return here(fitted).select(scene, "y", (1 / (1 + F.exp(-margin))).alias("p"))
