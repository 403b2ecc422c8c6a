"""Queries of metrics, sweeps, ranking curves, calibration, ensembles and threshold choice."""

from functools import reduce

from pyspark.sql import functions as F

from gridmetric.functions import scalar as S
from gridmetric.operators import auc, calibration, ensemble, metrics, sweep, threshold
from gridmetric.plans.registry import query
from gridmetric.sources import fixtures as X
from gridmetric.sources.fixtures import PX_SQL, PXV_SQL, PXW_SQL

T = S.threshold_grid(0.0, 1.0, 0.01)
SCORES = [f"p_{k}" for k in range(X.N)]
_D = lambda x: f"CAST({x} AS DOUBLE)"
_M = {
    "oa": f"{_D('tp + tn')} / nullif(tp + tn + fp + fn, 0)", "f1": f"coalesce({_D('2 * tp')} / nullif(2 * tp + fp + fn, 0), 0)", "precision": f"coalesce({_D('tp')} / nullif(tp + fp, 0), 0)",
    "recall": f"coalesce({_D('tp')} / nullif(tp + fn, 0), 0)", "iou": f"coalesce({_D('tp')} / nullif(tp + fp + fn, 0), 0)",
    "mcc": f"coalesce(({_D('tp')} * tn - {_D('fp')} * fn) / nullif(sqrt({_D('tp + fp')} * {_D('tp + fn')} * {_D('tn + fp')} * {_D('tn + fn')}), 0), 0)",
}
_METRICS = ", ".join(f"round({v}, 9) AS {k}" for k, v in _M.items())
_ENS = f"round({_D('tp')} / nullif(tp + fp + fn, 0), 9) AS iou, round({_M['precision']}, 9) AS precision, round({_M['recall']}, 9) AS recall"
_CONF = "count(*) FILTER (y = 0 AND q = 0) AS tn, count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn, count(*) FILTER (y = 1 AND q = 1) AS tp"
_PER_SCENE = f"{PX_SQL}, c AS (SELECT model_name, scene, {_CONF}, count(*) AS n_pixels FROM (SELECT model_name, scene, y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS q FROM px) GROUP BY ALL), m AS (SELECT *, {_METRICS} FROM c)"


def _spread(names, ci=False, spread=True):
    out = []
    for m in names:
        out += [f"round(avg({m}), 9) AS {m}_mean", f"round(stddev_samp({m}), 9) AS {m}_std"]
        out += [f"round(quantile_cont({m}, 0.025), 9) AS {m}_ci_low", f"round(quantile_cont({m}, 0.975), 9) AS {m}_ci_high"] * ci
        out += [f"round(min({m}), 9) AS {m}_min", f"round(max({m}), 9) AS {m}_max"] * spread
    return ", ".join(out)


def per_scene(spark, sf):
    px = X.px(spark, sf)
    c = metrics.confusion_counts(px, ["model_name", "scene"], F.col("y"), S.threshold_probability("p", 0.5))
    return metrics.with_columns(c, metrics.binary_metrics())


@query(f"WITH {_PER_SCENE} SELECT * EXCLUDE (n_pixels) FROM m")
def confusion_metrics(spark, sf):
    return per_scene(spark, sf)


@query(f"WITH {_PER_SCENE} SELECT model_name, count(*) AS n_scenes, {_spread(_M)} FROM m GROUP BY model_name")
def metric_groups(spark, sf):
    return metrics.metric_groups(per_scene(spark, sf), ["model_name"])


@query(f"WITH {_PER_SCENE} SELECT model_name, count(DISTINCT scene) AS n_pairs, CAST(sum(n_pixels) AS BIGINT) AS total_pixels, {_spread(_M, ci=True)} FROM m GROUP BY model_name")
def pair_macro_summary(spark, sf):
    rows = per_scene(spark, sf).withColumn("n_pixels", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return metrics.model_from_pairs(rows)


@query(f"WITH {_PER_SCENE} SELECT model_name, scene, " + ", ".join(f"{m} AS {m}_mean, CAST(NULL AS DOUBLE) AS {m}_std, CAST(NULL AS DOUBLE) AS {m}_ci_low, CAST(NULL AS DOUBLE) AS {m}_ci_high" for m in _M) + " FROM m")
def pair_summary(spark, sf):
    return metrics.pair_summary(per_scene(spark, sf), ["model_name", "scene"])


@query(f"""WITH {PXW_SQL}, c AS (SELECT scene, {', '.join(f'count(*) FILTER (ref = {i} AND q = {j}) AS "CM_{i}_{j}"' for i in (0, 1) for j in (0, 1))} FROM (SELECT scene, ref, CASE WHEN p_4 > 0.5 THEN 1 ELSE 0 END AS q FROM pxw) WHERE ref <> 255 GROUP BY scene)
SELECT *, round((coalesce({_D('"CM_0_0"')} / nullif("CM_0_0" + "CM_0_1" + "CM_1_0", 0), 0) + coalesce({_D('"CM_1_1"')} / nullif("CM_1_1" + "CM_0_1" + "CM_1_0", 0), 0)) / 2, 9) AS miou,
round((coalesce({_D('2 * "CM_0_0"')} / nullif(2 * "CM_0_0" + "CM_0_1" + "CM_1_0", 0), 0) + coalesce({_D('2 * "CM_1_1"')} / nullif(2 * "CM_1_1" + "CM_0_1" + "CM_1_0", 0), 0)) / 2, 9) AS macro_f1 FROM c""")
def macro_miou_f1(spark, sf):
    x = X.pxw(spark, sf, "scene", "ref", "p_4").withColumn("q", S.threshold_probability("p_4", 0.5))
    return metrics.macro_scores(x, ["scene"], "ref", "q")


_GROUPS = {"fn_all_cnn": "y = 1 AND NOT p_0 > 0.5 AND NOT p_1 > 0.5 AND NOT p_2 > 0.5", "tp_all_cnn": "y = 1 AND p_0 > 0.5 AND p_1 > 0.5 AND p_2 > 0.5", "tr_fn_cnn_tp": "y = 1 AND NOT p_3 > 0.5 AND p_0 > 0.5 AND p_1 > 0.5 AND p_2 > 0.5", "water": "y = 1"}


@query(f"WITH {PXV_SQL} SELECT scene, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _GROUPS.items()) + " FROM pxv GROUP BY scene")
def backscatter_counts(spark, sf):
    x = X.pxw_valid(spark, sf, "scene", "y", *SCORES[:4])
    return x.groupBy("scene").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in _GROUPS.items()))


_PCT = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(f"WITH {PXV_SQL}, g AS (" + " UNION ALL ".join(f"SELECT '{n}' AS grp, vv, vh FROM pxv WHERE {c}" for n, c in _GROUPS.items()) + ") SELECT grp, count(*) AS n, " + ", ".join(f"round(avg({b}), 9) AS {b}_mean, round(stddev_pop({b}), 9) AS {b}_std, " + ", ".join(f"round(quantile_cont({b}, {q}), 9) AS {b}_p{int(q * 100)}" for q in _PCT) for b in ("vv", "vh")) + " FROM g GROUP BY grp")
def backscatter_stats(spark, sf):
    x = X.pxw_valid(spark, sf, "scene", "y", "vv", "vh", *SCORES[:4]).where(S.finite("vv", "vh"))
    names = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _GROUPS.items()]))
    g = x.select(F.explode(names).alias("grp"), "vv", "vh")
    moments = [c for b in ("vv", "vh") for c in (F.round(F.avg(b), 9).alias(f"{b}_mean"), F.round(F.stddev_pop(b), 9).alias(f"{b}_std"))]
    out = g.groupBy("grp").agg(F.count("*").alias("n"), *moments)
    for b in ("vv", "vh"):
        names = {f"{b}_p{int(q * 100)}": q for q in _PCT}
        own = metrics.percentiles(g, ["grp"], b, names)
        out = out.join(own.select("grp", *(F.round(n, 9).alias(n) for n in names)), "grp", "left")
    return out


# Sweeps

_SWEEP = f"{PX_SQL}, t AS (SELECT i AS t_idx, i / 100.0 AS threshold FROM (SELECT CAST(unnest(range(0, 101)) AS INT) AS i)), sc AS (SELECT model_name, scene, t_idx, CAST(round(threshold, 10) AS DOUBLE) AS threshold, {_CONF} FROM (SELECT model_name, scene, t_idx, threshold, y, CASE WHEN p > CAST(t_idx AS DOUBLE) / 100 THEN 1 ELSE 0 END AS q FROM px CROSS JOIN t) GROUP BY ALL), sw AS (SELECT *, {_METRICS} FROM sc)"
_LONG = "SELECT model_name, scene, t_idx, threshold, unnest(['iou', 'f1', 'mcc']) AS metric, unnest([iou, f1, mcc]) AS value FROM sw"
_LOO = f"{_SWEEP}, lg AS ({_LONG}), tr AS (SELECT *, round((sum(value) OVER w - value) / (count(*) OVER w - 1), 12) AS train_mean, count(*) OVER w AS nn FROM lg WINDOW w AS (PARTITION BY model_name, metric, t_idx)), loo AS (SELECT model_name, scene AS held_out, metric, t_idx, threshold, train_mean, value AS held_out_value FROM (SELECT *, row_number() OVER (PARTITION BY model_name, metric, scene ORDER BY train_mean DESC, t_idx) AS rk FROM tr WHERE nn > 1) WHERE rk = 1)"
_SUMMARY = f"{_SWEEP}, sm AS (SELECT model_name, t_idx, threshold, count(*) AS n_pairs, {_spread(_M, spread=False)} FROM sw GROUP BY ALL)"


def sweep_of(spark, sf):
    return sweep.threshold_sweep(X.px(spark, sf), ["model_name", "scene"], T)


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def threshold_sweep(spark, sf):
    return sweep_of(spark, sf)


@query(f"WITH {_SUMMARY} SELECT * FROM sm")
def sweep_summary(spark, sf):
    return sweep.sweep_summary(sweep_of(spark, sf))


@query(f"WITH {_SUMMARY}, b AS (SELECT model_name, t_idx, threshold, unnest(['iou', 'f1', 'mcc']) AS metric, unnest([iou_mean, f1_mean, mcc_mean]) AS value FROM sm) SELECT model_name, t_idx, threshold, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY value DESC, t_idx) AS rk FROM b WHERE value IS NOT NULL) WHERE rk = 1")
def best_threshold(spark, sf):
    return sweep.best_threshold(sweep.sweep_summary(sweep_of(spark, sf)))


@query(f"WITH {_LOO} SELECT * FROM loo")
def loo_threshold(spark, sf):
    return sweep.loo_threshold(sweep_of(spark, sf))


@query(f"WITH {_LOO} SELECT model_name, metric, count(*) AS n_scenes, {_spread(('held_out_value',))}, {_spread(('threshold',), spread=False)} FROM loo GROUP BY ALL")
def loo_summary(spark, sf):
    return sweep.loo_summary(sweep.loo_threshold(sweep_of(spark, sf)))


# Ranking curves

_AUC = f"""{PX_SQL}, g AS (SELECT model_name, scene, p, CAST(sum(y) AS DOUBLE) AS w, CAST(sum(1 - y) AS DOUBLE) AS l FROM px GROUP BY ALL),
cu AS (SELECT *, sum(w) OVER o AS cw, sum(l) OVER o AS cl, sum(w) OVER (PARTITION BY model_name, scene) AS tw FROM g WINDOW o AS (PARTITION BY model_name, scene ORDER BY p DESC)),
a AS (SELECT model_name, scene, sum(l * (cw - w) + l * w / 2) AS area, max(tw) AS tw, sum(l) AS tl, sum(w / nullif(tw, 0) * cw / nullif(cw + cl, 0)) AS ap FROM cu GROUP BY ALL)"""


@query(f"WITH {_AUC} SELECT model_name, scene, CASE WHEN tw > 0 AND tl > 0 THEN round(area / (tw * tl), 9) END AS roc_auc, CASE WHEN tw > 0 AND tl > 0 THEN 'success' ELSE 'undefined_single_class_reference' END AS auc_status FROM a")
def roc_auc(spark, sf):
    return auc.auc_summary(X.px(spark, sf), ["model_name", "scene"]).drop("average_precision")


@query(f"WITH {_AUC} SELECT model_name, scene, round(ap, 9) AS average_precision FROM a")
def average_precision(spark, sf):
    return auc.auc_summary(X.px(spark, sf), ["model_name", "scene"]).select("model_name", "scene", "average_precision")


_SPINE = "(SELECT CAST(unnest(range(0, 1000)) AS INT) AS bin)"
_CURVE = f"{PX_SQL}, e AS (SELECT [i * 0.001e0 for i in range(0, 1000)] || [1.0e0] AS e), hb AS (SELECT model_name, scene, bin, sum(y) AS w, sum(1 - y) AS l FROM (SELECT model_name, scene, y, CASE WHEN p = 1.0 THEN 999 ELSE CASE WHEN p < e[gg + 1] THEN gg - 1 WHEN gg < 999 AND p >= e[gg + 2] THEN gg + 1 ELSE gg END END AS bin FROM (SELECT *, CAST(greatest(0, least(999, floor(p * 1000))) AS INT) AS gg FROM px), e) GROUP BY ALL), cv AS (SELECT k.model_name, k.scene, s.bin, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS tp, CAST(coalesce(sum(l) OVER o, 0) AS BIGINT) AS fp FROM (SELECT DISTINCT model_name, scene FROM hb) k CROSS JOIN {_SPINE} s LEFT JOIN hb ON hb.model_name = k.model_name AND hb.scene = k.scene AND hb.bin = s.bin WINDOW o AS (PARTITION BY k.model_name, k.scene ORDER BY s.bin DESC))"


@query(f"WITH {_CURVE} SELECT * FROM cv")
def score_curves(spark, sf):
    return auc.score_curves(X.px(spark, sf), ["model_name", "scene"])


@query(f"WITH {_CURVE}, pl AS (SELECT model_name, bin, sum(tp) AS tp, sum(fp) AS fp FROM cv GROUP BY ALL), pt AS (SELECT model_name, bin, coalesce({_D('tp')} / nullif(max(tp) OVER (PARTITION BY model_name), 0), 0) AS r, coalesce({_D('tp')} / nullif(tp + fp, 0), 1) AS p FROM pl), st AS (SELECT model_name, (r - lag(r) OVER o) * (p + lag(p) OVER o) / 2 AS area FROM pt WINDOW o AS (PARTITION BY model_name ORDER BY r, bin DESC)) SELECT model_name, round(coalesce(sum(area), 0), 9) AS auc_pr FROM st GROUP BY model_name")
def auc_pr(spark, sf):
    return auc.auc_pr(auc.score_curves(X.px(spark, sf), ["model_name"]), ["model_name"])


_PR = f"{_SWEEP}, pc AS (SELECT model_name, scene, r, max(p) AS p FROM (SELECT model_name, scene, CASE WHEN tp = 0 AND fp = 0 THEN 0.0 ELSE recall END AS r, CASE WHEN tp = 0 AND fp = 0 THEN 1.0 ELSE precision END AS p FROM sw) GROUP BY ALL)"


@query(f"WITH {_PR} SELECT model_name, scene, r AS recall, p AS precision FROM pc")
def pr_sentinel(spark, sf):
    return auc.pr_curve(sweep_of(spark, sf), ["model_name", "scene"])


@query(f"WITH {_PR}, st AS (SELECT model_name, scene, (r - lag(r) OVER o) * (p + lag(p) OVER o) / 2 AS area FROM pc WINDOW o AS (PARTITION BY model_name, scene ORDER BY r)) SELECT model_name, scene, round(coalesce(sum(area), 0), 9) AS pr_ap FROM st GROUP BY ALL")
def pr_curve_ap(spark, sf):
    return auc.pr_curve_ap(sweep_of(spark, sf), ["model_name", "scene"])


# Calibration

_FINE = f"{PX_SQL}, fh AS (SELECT model_name, least(CAST(floor(greatest(0.0, least(1.0, p)) * 1000) AS INT), 999) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, sum(p) AS sum_p FROM px GROUP BY ALL)"


def _fine(spark, sf):
    return calibration.fine_histogram(X.px(spark, sf), ["model_name"])


@query(f"WITH {_FINE} SELECT model_name, bin, n, pos, round(sum_p, 6) AS sum_p FROM fh")
def fine_hist(spark, sf):
    return _fine(spark, sf).withColumn("sum_p", F.round("sum_p", 6))


@query(f"WITH {PX_SQL} SELECT model_name, scene, count(*) AS n, round(avg(y), 9) AS prevalence, round(avg(p), 9) AS mean_p, round(avg((p - y) * (p - y)), 9) AS brier FROM px GROUP BY ALL")
def brier(spark, sf):
    return calibration.brier(X.px(spark, sf), ["model_name", "scene"])


_FIXED = [float(e) for e in calibration.fixed_edges(10)]
_COARSE_FIXED = f"{_FINE}, cz AS (SELECT model_name, CAST(least(len(list_filter({_FIXED}, lambda e: CAST(bin AS DOUBLE) / 1000 >= e)) - 1, 9) AS INT) AS k, sum(n) AS n, sum(pos) AS pos, sum(sum_p) AS sum_p FROM fh GROUP BY ALL), ct AS (SELECT m.model_name, ({_FIXED})[s.k + 1] AS bin_left, ({_FIXED})[s.k + 2] AS bin_right, CAST(coalesce(n, 0) AS BIGINT) AS n, round(sum_p / nullif(n, 0), 9) AS mean_pred, round({_D('pos')} / nullif(n, 0), 9) AS obs_freq FROM (SELECT DISTINCT model_name FROM fh) m CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS k) s LEFT JOIN cz ON cz.model_name = m.model_name AND cz.k = s.k)"
_ECE = "SELECT model_name, round(sum(abs(obs_freq - mean_pred) * n) / sum(n), 8) AS ece, round(max(abs(obs_freq - mean_pred)), 8) AS mce FROM ct WHERE n > 0 GROUP BY model_name"


@query(f"WITH {_COARSE_FIXED} SELECT model_name, round(bin_left, 9) AS bin_left, round(bin_right, 9) AS bin_right, n, mean_pred, obs_freq FROM ct")
def reliability_fixed(spark, sf):
    return calibration.coarse_table(_fine(spark, sf), ["model_name"], _FIXED)


@query(f"WITH {_COARSE_FIXED} {_ECE}")
def ece_fixed(spark, sf):
    return calibration.ece_mce(calibration.coarse_table(_fine(spark, sf), ["model_name"], _FIXED), ["model_name"])


_QE = f"{_FINE}, cum AS (SELECT model_name, bin, sum(n) OVER (PARTITION BY model_name ORDER BY bin) AS c, sum(n) OVER (PARTITION BY model_name) AS t FROM fh), ed AS (SELECT DISTINCT model_name, edge FROM (SELECT model_name, CAST(min(bin) + 1 AS INT) AS edge FROM cum, (SELECT CAST(unnest(range(1, 10)) AS INT) AS k) WHERE c * 10 >= k * t GROUP BY model_name, k UNION ALL SELECT DISTINCT model_name, unnest([0, 1000]) FROM fh))"
_CT = f"{_QE}, sp AS (SELECT model_name, edge, lead(edge) OVER (PARTITION BY model_name ORDER BY edge) AS nxt FROM ed), ct AS (SELECT sp.model_name, edge / 1000.0 AS bin_left, nxt / 1000.0 AS bin_right, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(sum(sum_p) / nullif(sum(n), 0), 9) AS mean_pred, round({_D('sum(pos)')} / nullif(sum(n), 0), 9) AS obs_freq FROM sp LEFT JOIN fh ON fh.model_name = sp.model_name AND fh.bin >= edge AND fh.bin < nxt WHERE nxt IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_QE} SELECT * FROM ed")
def quantile_edges(spark, sf):
    return calibration.quantile_edges(_fine(spark, sf), ["model_name"], 10)


@query(f"WITH {_CT} {_ECE}")
def ece_quantile(spark, sf):
    fine = _fine(spark, sf)
    return calibration.ece_mce(calibration.coarse_table(fine, ["model_name"], calibration.quantile_edges(fine, ["model_name"], 10)), ["model_name"])


# Ensembles

_MASK = " + ".join(f"(CASE WHEN p_{k} > 0.5 THEN {1 << k} ELSE 0 END)" for k in range(X.N))
_ALL = (1 << X.N) - 1
_PAT = f"{PXV_SQL}, pt AS (SELECT scene, y, CAST({_MASK} AS BIGINT) AS pred_mask, count(*) AS n FROM pxv GROUP BY ALL), er AS (SELECT *, CASE WHEN y = 1 THEN xor({_ALL}, pred_mask) ELSE pred_mask END AS e FROM pt)"
_VOTED = "CAST(coalesce(sum(n) FILTER (v AND y = 1), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (v AND y = 0), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (NOT v AND y = 1), 0) AS BIGINT) AS fn"
_MECHS = {m: sum(1 << k for k in range(X.N) if X.MEMBERS[k][5] == i) for i, m in enumerate(X.MECHANISM_NAMES)}


def patterns(spark, sf):
    return ensemble.pattern_table(X.pxw_valid(spark, sf, "scene", "y", *SCORES), SCORES)


@query(f"WITH {_PAT} SELECT * FROM pt")
def pattern_table(spark, sf):
    return patterns(spark, sf)


def _vote_sql(mask: int, by: str = "") -> str:
    k = bin(mask).count("1")
    return f"SELECT {by}tp, fp, fn, {_ENS} FROM (SELECT {by}{_VOTED} FROM (SELECT *, 2 * bit_count(pred_mask & {mask}) >= {k} AS v FROM pt) {'GROUP BY ' + by.rstrip(', ') if by else ''})"


@query(f"WITH {_PAT} {_vote_sql(_ALL, 'scene, ')}")
def majority_vote_all(spark, sf):
    return ensemble.vote(patterns(spark, sf), _ALL, X.N, ("scene",))


@query(f"WITH {_PAT} " + " UNION ALL ".join(f"SELECT '{m}' AS mechanism, * FROM ({_vote_sql(mask)})" for m, mask in _MECHS.items() if bin(mask).count("1") >= 2))
def mechanism_votes(spark, sf):
    p = patterns(spark, sf)
    parts = [ensemble.vote(p, mask, X.N).withColumn("mechanism", F.lit(m)) for m, mask in _MECHS.items() if bin(mask).count("1") >= 2]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"WITH {_PAT} SELECT tp, fp, fn, {_ENS} FROM (SELECT {_VOTED} FROM (SELECT *, CASE WHEN e <> {_ALL} THEN y = 1 ELSE y = 0 END AS v FROM er))")
def oracle_bound(spark, sf):
    return ensemble.oracle_bound(patterns(spark, sf), X.N)


_EXH = f"{_PAT}, ex AS (SELECT CAST(subset AS BIGINT) AS subset, CAST(bit_count(subset) AS INT) AS k, tp, fp, fn, {_ENS} FROM (SELECT subset, {_VOTED} FROM (SELECT subset, y, n, 2 * bit_count(pred_mask & subset) >= bit_count(subset) AS v FROM pt, (SELECT CAST(unnest(range(1, {_ALL + 1})) AS BIGINT) AS subset)) GROUP BY subset))"
_COMP = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN subset & {m} <> 0 THEN '{g}' END" for g, m in sorted(_MECHS.items())) + "], lambda x: x IS NOT NULL), '+') AS composition"


@query(f"WITH {_EXH} SELECT * FROM ex")
def exhaustive_votes(spark, sf):
    return ensemble.exhaustive_votes(patterns(spark, sf), X.N)


@query(f"WITH {_EXH} SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY iou DESC, subset) AS rk FROM ex) WHERE rk = 1")
def best_per_k(spark, sf):
    return ensemble.best_per(ensemble.exhaustive_votes(patterns(spark, sf), X.N), "k")


@query(f"WITH {_EXH}, co AS (SELECT *, {', '.join(f'CAST(bit_count(subset & {m}) AS INT) AS n_{g.lower()}' for g, m in _MECHS.items())}, {_COMP} FROM ex) SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY composition ORDER BY iou DESC, subset) AS rk FROM co) WHERE rk = 1")
def best_per_composition(spark, sf):
    votes = ensemble.exhaustive_votes(patterns(spark, sf), X.N).withColumns(ensemble.composition("subset", _MECHS))
    return ensemble.best_per(votes, "composition")


def _pair_sql(where: str) -> str:
    return f"pw AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(coalesce(sum(n) FILTER ((e >> a) & 1 = 1), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(n) FILTER ((e >> b) & 1 = 1), 0) AS BIGINT) AS n_b, CAST(coalesce(sum(n) FILTER ((e >> a) & 1 = 1 AND (e >> b) & 1 = 1), 0) AS BIGINT) AS n_both FROM er, (SELECT CAST(unnest(range(0, {X.N})) AS BIGINT) AS a), (SELECT CAST(unnest(range(0, {X.N})) AS BIGINT) AS b) {where} GROUP BY ALL), pj AS (SELECT *, round({_D('n_both')} / nullif(n_a + n_b - n_both, 0), 9) AS jaccard, round({_D('n_both')} / nullif(n_b, 0), 9) AS cond FROM pw)"


@query(f"WITH {_PAT}, {_pair_sql('')} SELECT * EXCLUDE cond FROM pj")
def error_jaccard(spark, sf):
    return ensemble.pairwise_errors(patterns(spark, sf), X.N).drop("cond")


@query(f"WITH {_PAT}, {_pair_sql('')} SELECT a, b, cond FROM pj")
def error_conditional(spark, sf):
    return ensemble.pairwise_errors(patterns(spark, sf), X.N).select("a", "b", "cond")


@query(f"WITH {_PAT}, {_pair_sql('WHERE y = 0')} SELECT * FROM pj")
def error_jaccard_fp(spark, sf):
    return ensemble.pairwise_errors(patterns(spark, sf), X.N, "fp")


@query(f"WITH {_PAT}, {_pair_sql('WHERE y = 1')} SELECT * FROM pj")
def error_jaccard_fn(spark, sf):
    return ensemble.pairwise_errors(patterns(spark, sf), X.N, "fn")


@query(f"WITH {_PAT} SELECT k.scene, s.n_wrong, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT scene FROM er) k CROSS JOIN (SELECT CAST(unnest(range(0, {X.N + 1})) AS INT) AS n_wrong) s LEFT JOIN er ON er.scene = k.scene AND bit_count(er.e) = s.n_wrong GROUP BY ALL")
def error_multiplicity(spark, sf):
    return ensemble.multiplicity(patterns(spark, sf), X.N, ("scene",))


_NAMES = [X.MECHANISM_NAMES[m[5]] for m in X.MEMBERS]


@query(f"WITH {_PAT}, {_pair_sql('')}, nm AS (SELECT least(({_NAMES})[a + 1], ({_NAMES})[b + 1]) AS m1, greatest(({_NAMES})[a + 1], ({_NAMES})[b + 1]) AS m2, jaccard FROM pj WHERE a < b) SELECT m1, m2, count(*) AS n_pairs, round(avg(jaccard), 9) AS mean_jaccard FROM nm GROUP BY ALL")
def mechanism_jaccard(spark, sf):
    return ensemble.mechanism_jaccard(ensemble.pairwise_errors(patterns(spark, sf), X.N), _NAMES)


@query(f"WITH {_PAT}, s AS (SELECT CAST(coalesce(sum(n) FILTER (e <> 0), 0) AS BIGINT) AS n_any, CAST(coalesce(sum(n) FILTER (e = {_ALL}), 0) AS BIGINT) AS n_all FROM er) SELECT *, round({_D('n_all')} / n_any, 9) AS shared, round(1 - {_D('n_all')} / n_any, 9) AS recoverable FROM s")
def shared_errors(spark, sf):
    return ensemble.shared_errors(patterns(spark, sf), X.N)


@query(f"WITH {_PAT}, v AS ({_vote_sql(_ALL, 'scene, ')}) SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(iou), 9) AS macro_iou, round({_D('sum(tp)')} / nullif(sum(tp) + sum(fp) + sum(fn), 0), 9) AS micro_iou FROM v")
def micro_vs_macro(spark, sf):
    return ensemble.micro_macro(patterns(spark, sf), _ALL, X.N)


_MEAN = "(" + " + ".join(SCORES) + f") / {X.N}"


@query(f"WITH {PXV_SQL} SELECT scene, {_CONF} FROM (SELECT scene, y, CASE WHEN {_MEAN} > 0.5 THEN 1 ELSE 0 END AS q FROM pxv) GROUP BY scene")
def soft_mean(spark, sf):
    x = ensemble.soft_mean(X.pxw_valid(spark, sf, "scene", "y", *SCORES), SCORES)
    return metrics.confusion_counts(x, ["scene"], F.col("y"), S.threshold_probability("p", 0.5))


_CANDIDATES = ensemble.soft_candidates(X.N, list(_MECHS.values()))
_SUBSUM = " + ".join(f"(CASE WHEN (s.subset >> {k}) & 1 = 1 THEN p_{k} ELSE 0.0 END)" for k in range(X.N))


@query(f"WITH {PXV_SQL}, s AS (SELECT CAST(unnest({_CANDIDATES}) AS BIGINT) AS subset), v AS (SELECT subset, y = 1 AS y1, (0.0 + {_SUBSUM}) / bit_count(subset) > 0.5 AS v FROM pxv, s) SELECT subset, tp, fp, fn, {_ENS} FROM (SELECT subset, count(*) FILTER (v AND y1) AS tp, count(*) FILTER (v AND NOT y1) AS fp, count(*) FILTER (NOT v AND y1) AS fn FROM v GROUP BY subset)")
def soft_candidates(spark, sf):
    c = ensemble.soft_counts(X.pxw_valid(spark, sf, "y", *SCORES), SCORES, _CANDIDATES)
    return metrics.with_columns(c, ensemble.ensemble_metrics())


def _curve_sql(source: str, key: str) -> str:
    return f"hb AS (SELECT {key}scene, bin, sum(y) AS w, sum(1 - y) AS l FROM (SELECT {key}scene, y, CASE WHEN p = 1.0 THEN 99 ELSE len(list_filter([i * 0.01e0 for i in range(0, 100)], lambda x: p >= x)) - 1 END AS bin FROM {source} WHERE p BETWEEN 0 AND 1) GROUP BY ALL), cv AS (SELECT {''.join('k.' + c.strip() + ', ' for c in key.split(',') if c.strip())}k.scene, CAST(s.bin AS INT) AS bin, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS tp, CAST(coalesce(sum(l) OVER o, 0) AS BIGINT) AS fp FROM (SELECT DISTINCT {key}scene FROM hb) k CROSS JOIN (SELECT unnest(range(0, 100)) AS bin) s LEFT JOIN hb ON {''.join('hb.' + c.strip() + ' = k.' + c.strip() + ' AND ' for c in key.split(',') if c.strip())}hb.scene = k.scene AND hb.bin = s.bin WINDOW o AS (PARTITION BY {''.join('k.' + c.strip() + ', ' for c in key.split(',') if c.strip())}k.scene ORDER BY s.bin DESC)), fnv AS (SELECT *, max(tp) OVER (PARTITION BY {key}scene) - tp AS fn FROM cv), io AS (SELECT *, {_D('tp')} / nullif(tp + fp + fn, 0) AS iou FROM fnv)"


def _loo_sql(key: str, macro: bool) -> str:
    value = "(sum(iou) OVER w - iou) / nullif(count(iou) OVER w - 1, 0)" if macro else f"{_D('sum(tp) OVER w - tp')} / nullif(sum(tp) OVER w - tp + sum(fp) OVER w - fp + sum(fn) OVER w - fn, 0)"
    return f"SELECT {key}scene AS held_out, bin, tp, fp, fn, round(iou, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY {key}scene ORDER BY train DESC NULLS LAST, bin) AS rk FROM (SELECT *, round({value}, 9) AS train FROM io WINDOW w AS (PARTITION BY {key}bin))) WHERE rk = 1"


_SOFT3 = "sx AS (SELECT scene, y, (p_0 + p_3 + p_6) / 3 AS p FROM pxv)"


def _soft3(spark, sf):
    return auc.score_curves(ensemble.soft_mean(X.pxw_valid(spark, sf, "scene", "y", "p_0", "p_3", "p_6"), ["p_0", "p_3", "p_6"]), ["scene"], 100)


@query(f"WITH {PXV_SQL}, {_SOFT3}, {_curve_sql('sx', '')} {_loo_sql('', False)}")
def loo_tuned_micro(spark, sf):
    return ensemble.loo_tuned(_soft3(spark, sf))


@query(f"WITH {PXV_SQL}, {_SOFT3}, {_curve_sql('sx', '')} {_loo_sql('', True)}")
def loo_tuned_macro(spark, sf):
    return ensemble.loo_tuned(_soft3(spark, sf), macro=True)


def _pairs_sql() -> str:
    """Curves (io) of the nine weighted means of every two members, in hundredths."""
    members, key = ", ".join(f"p_{k}" for k in range(X.N)), "a, b, w10, scene"
    return f"""{PXV_SQL}, sx AS (SELECT scene, y, a, b, w10, (ps[a + 1] * w10 + ps[b + 1] * (10 - w10)) / 10 AS p FROM (SELECT scene, y, [{members}] AS ps FROM pxv), (SELECT CAST(unnest(range(0, {X.N})) AS INT) AS a), (SELECT CAST(unnest(range(0, {X.N})) AS INT) AS b), (SELECT CAST(unnest(range(1, 10)) AS INT) AS w10) WHERE a < b),
sg AS (SELECT *, least(99, CAST(floor(p * 100) AS INT)) AS g FROM sx WHERE p BETWEEN 0 AND 1),
hb AS (SELECT {key}, CASE WHEN p < g * 0.01e0 THEN g - 1 WHEN p >= (g + 1) * 0.01e0 AND g < 99 THEN g + 1 ELSE g END AS bin, sum(y) AS w, sum(1 - y) AS l FROM sg GROUP BY ALL),
fu AS (SELECT * FROM (SELECT DISTINCT {key} FROM hb), (SELECT CAST(unnest(range(0, 100)) AS INT) AS bin)),
cv AS (SELECT fu.*, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS tp, CAST(coalesce(sum(l) OVER o, 0) AS BIGINT) AS fp FROM fu LEFT JOIN hb USING ({key}, bin) WINDOW o AS (PARTITION BY {', '.join('fu.' + k for k in key.split(', '))} ORDER BY fu.bin DESC)),
io AS (SELECT *, {_D('tp')} / nullif(tp + fp + fn, 0) AS iou FROM (SELECT *, max(tp) OVER (PARTITION BY {key}) - tp AS fn FROM cv))"""


@query(f"WITH {_pairs_sql()} {_loo_sql('a, b, w10, ', False)}")
def weighted_pairs(spark, sf):
    """Thresholds of every weighted pair of members, tuned on the other scenes."""
    curves = ensemble.weighted_pair_curves(X.pxw_valid(spark, sf, "scene", "y", *SCORES), SCORES, 100)
    return ensemble.loo_tuned(curves, ("a", "b", "w10"))


_TUNED = [0.45, 0.45, 0.4, 0.5, 0.5, 0.55, 0.5]


def _wrong_sql(cuts):
    return " + ".join(f"(CASE WHEN (p_{k} > {t}) <> (y = 1) THEN 1 ELSE 0 END)" for k, t in enumerate(cuts))


@query(f"WITH {PXV_SQL}, w AS (SELECT scene, pix, y, {_wrong_sql(_TUNED)} AS n_wrong_tuned, {_wrong_sql([0.5] * X.N)} AS n_wrong_05 FROM pxv) SELECT *, n_wrong_tuned = {X.N} AS all_wrong, n_wrong_tuned >= {X.N - 2} AS most_wrong FROM w")
def consensus_errors(spark, sf):
    return ensemble.consensus_errors(X.pxw_valid(spark, sf, "scene", "pix", "y", *SCORES), SCORES, _TUNED)


# Threshold choice

_TCURVE = f"{_SWEEP}, tc AS (SELECT model_name, t_idx, threshold, round(avg(iou), 12) AS mean, coalesce(round(stddev_samp(iou), 12), 0) AS std FROM sw GROUP BY ALL)"


def _iou_rows(spark, sf):
    return sweep_of(spark, sf).select("model_name", F.col("scene").alias("pair"), "t_idx", "threshold", F.col("iou").alias("value"))


@query(f"WITH {_TCURVE}, rk AS (SELECT model_name, lambda_ AS lambda, t_idx, threshold, round(mean - lambda_ * std, 9) AS risk FROM tc, (SELECT CAST(unnest([0.5, 1.0, 2.0]) AS DOUBLE) AS lambda_)) SELECT model_name, lambda, t_idx, threshold, risk FROM (SELECT *, row_number() OVER (PARTITION BY model_name, lambda ORDER BY risk DESC, t_idx) AS n FROM rk) WHERE n = 1".replace("lambda_ AS lambda,", 'lambda_ AS "lambda",').replace("model_name, lambda, t_idx", 'model_name, "lambda", t_idx').replace("model_name, lambda ORDER", 'model_name, "lambda" ORDER'))
def risk_adjusted(spark, sf):
    return threshold.risk_adjusted(threshold.curve(_iou_rows(spark, sf), ["model_name"]), ["model_name"])


@query(f"""WITH {_TCURVE}, cvs AS (SELECT *, CASE WHEN mean > 0 THEN round(std / mean, 9) END AS cv FROM tc), q AS (SELECT model_name, round(quantile_cont(cv, 0.25), 9) AS cut FROM cvs GROUP BY model_name), pk AS (SELECT model_name, t_idx AS a FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY mean DESC, t_idx) AS n FROM tc) WHERE n = 1),
fl AS (SELECT c.model_name, t_idx AS i, a, coalesce(cv <= cut, FALSE) AS ok FROM cvs c JOIN q ON q.model_name = c.model_name JOIN pk ON pk.model_name = c.model_name),
g AS (SELECT model_name, max(a) AS a, bool_or(ok) AS found, min(i) AS f, max(i) AS l, max(i) FILTER (i < a AND NOT ok) AS b, min(i) FILTER (i > a AND NOT ok) AS t FROM fl GROUP BY model_name)
SELECT model_name, CASE WHEN found THEN coalesce(b + 1, f) ELSE a END AS low, CASE WHEN found THEN coalesce(t - 1, l) ELSE a END AS high FROM g""")
def low_cv_interval(spark, sf):
    return threshold.low_cv_interval(threshold.curve(_iou_rows(spark, sf), ["model_name"]), ["model_name"])


@query()
def tost(spark, sf):
    return threshold.tost(_iou_rows(spark, sf), ["model_name"], delta=0.02)


@query()
def recommendation(spark, sf):
    return threshold.recommend(_iou_rows(spark, sf), ["model_name"], delta=0.02)


def _greedy_sql() -> str:
    """A step is the best of the subsets that add one member to the step before; ties take the larger number."""
    ctes, rows = ["g0 AS (SELECT CAST(0 AS BIGINT) AS subset)"], []
    for k in range(1, X.N + 1):
        ctes.append(f"g{k} AS (SELECT ex.subset, ex.iou, xor(ex.subset, b.subset) AS added FROM ex, g{k - 1} b WHERE ex.k = {k} AND ex.subset & b.subset = b.subset ORDER BY coalesce(ex.iou, -1) DESC, ex.subset DESC LIMIT 1)")
        rows.append(f"SELECT {k} AS step, CAST(round(log2(added)) AS INT) AS added, subset, iou FROM g{k}")
    return f"WITH {_EXH}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query(_greedy_sql())
def greedy_ensemble(spark, sf):
    rows = ensemble.greedy_selection(patterns(spark, sf), X.N)
    return spark.createDataFrame([(r["step"], r["added"], r["subset"], r["iou"]) for r in rows], "step int, added int, subset long, iou double")


@query()
def logreg_stacker(spark, sf):
    x = ensemble.logistic_stacker(X.pxw_valid(spark, sf, "scene", "y", *SCORES), SCORES)
    return metrics.confusion_counts(x, ["scene"], F.col("y"), S.threshold_probability("p", 0.5))


_KDE_GRID = [-28.0 + i for i in range(0, 26, 5)]


@query(f"""WITH {PXV_SQL}, s AS (SELECT y, count(*) AS n, stddev_samp(vv) * pow(count(*), -0.2) AS h FROM pxv GROUP BY y HAVING count(*) >= 100), g AS (SELECT CAST(unnest({_KDE_GRID}) AS DOUBLE) AS at_),
x AS (SELECT p.y, n, h, floor(vv * 32 / h) AS b, vv * 32 / h - floor(vv * 32 / h) AS f FROM pxv p JOIN s ON p.y = s.y), w AS (SELECT y, n, h, b, sum(1 - f) AS w FROM x GROUP BY ALL UNION ALL SELECT y, n, h, b + 1, sum(f) FROM x GROUP BY ALL)
SELECT y, at_ AS "at", round(sum(w * exp(-pow(at_ / h - b / 32, 2) / 2)) / max(n * h * 2.5066282746310002), 9) AS density FROM w, g GROUP BY ALL""")
def kde_1d(spark, sf):
    from gridmetric.operators.sampling import kde

    return kde(X.pxw_valid(spark, sf, "y", "vv"), ["y"], "vv", _KDE_GRID)
