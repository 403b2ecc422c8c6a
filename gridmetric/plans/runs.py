"""Queries of run manifests, reports, sources and sinks. Files go to a new folder in spark.checkpoint.dir and are read back."""

import numpy as np
from pyspark.sql import functions as F

from gridmetric.functions import scalar as S
from gridmetric.operators import auc, blocks, calibration, ensemble, geometry, manifest, metrics, overlay, ranking, sampling, threshold, tiles
from gridmetric.plans import analytics as A
from gridmetric.plans import relations as R
from gridmetric.plans import tiles as P
from gridmetric.plans.registry import query
from gridmetric.sources import files, shared
from gridmetric.sources import fixtures as X
from gridmetric.sources.fixtures import PX_SQL, PXV_SQL, PXW_SQL

# Reports

_PAIRS = f"WITH r AS ({R._RUNS}), p AS (SELECT event_type AS model, user_id AS pair, iou, user_id * 10 + 7 AS n_pixels FROM r)"
_FAMILIES = (("view", "CNN"), ("click", "Transformer"), ("purchase", None))


def _family_table(spark):
    return spark.createDataFrame(list(_FAMILIES), "model string, family string")


def _pairs(spark, sf):
    return R._runs(spark, sf).select(F.col("event_type").alias("model"), F.col("user_id").alias("pair"), "iou", (F.col("user_id") * 10 + 7).alias("n_pixels"))


@query(f"""{_PAIRS}, s AS (SELECT model, count(iou) AS n_pairs, CAST(sum(n_pixels) AS BIGINT) AS total_pixels, round(avg(iou), 9) AS iou_mean, round(median(iou), 9) AS iou_median, round(stddev_samp(iou), 9) AS iou_std,
round(min(iou), 9) AS iou_min, round(max(iou), 9) AS iou_max, round(quantile_cont(iou, 0.025), 9) AS iou_ci_low, round(quantile_cont(iou, 0.975), 9) AS iou_ci_high FROM p GROUP BY model)
SELECT s.*, family, row_number() OVER (ORDER BY iou_mean DESC NULLS LAST, s.model) AS rank FROM s LEFT JOIN (VALUES ('view', 'CNN'), ('click', 'Transformer'), ('purchase', NULL)) f(m, family) ON f.m = s.model""")
def model_ranking(spark, sf):
    return ranking.model_ranking(_pairs(spark, sf), "model", "iou", "n_pixels", _family_table(spark))


_SPREAD = ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std, round(min({m}), 9) AS {m}_min, round(max({m}), 9) AS {m}_max" for m in ("roc_auc", "average_precision"))


@query(f"""WITH {A._AUC}, m AS (SELECT model_name, CASE WHEN tw > 0 AND tl > 0 THEN round(area / (tw * tl), 9) END AS roc_auc, CASE WHEN tw > 0 AND tl > 0 THEN round(ap, 9) END AS average_precision FROM a)
SELECT model_name, count(*) AS n_pairs, count(roc_auc) AS n_success_pairs, {_SPREAD} FROM m GROUP BY model_name""")
def auc_summary_by_model(spark, sf):
    return auc.summary_by_model(auc.auc_summary(X.px(spark, sf), ["model_name", "scene"]), "model_name")


@query(f"WITH {PXV_SQL} SELECT scene, min(s) AS score_min, max(s) AS score_max, round(avg(s), 9) AS score_mean FROM (SELECT scene, CASE WHEN vh > -30 THEN p_1 END AS s FROM pxv) GROUP BY scene")
def score_range(spark, sf):
    x = X.pxw_valid(spark, sf, "scene", "vh", "p_1")
    return auc.score_range(x.select("scene", F.when(F.col("vh") > -30, F.col("p_1")).otherwise(float("nan")).alias("s")), ["scene"], "s")


@query("SELECT CAST(floor(event_id / 250) AS BIGINT) AS interval, count(value) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / count(value) / 100.0, 6) AS mean FROM events GROUP BY 1")
def interval_means(spark, sf):
    return ranking.interval_means(X.log(spark, sf), "event_id", "value", 250)


@query("SELECT CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'view'), 0) AS BIGINT) AS freed FROM events")
def freed_bytes(spark, sf):
    return shared.freed_bytes(X.log(spark, sf).select((F.col("event_type") == "view").alias("deleted"), F.round(F.col("value") * 100).cast("long").alias("bytes")))


@query(f"WITH {A._PAT}, {A._pair_sql('')} SELECT a, b, jaccard, rank FROM (SELECT a, b, jaccard, row_number() OVER (ORDER BY jaccard DESC, a, b) AS rank FROM pj WHERE a < b) WHERE rank <= 5")
def top_pairs(spark, sf):
    """The five pairs of members that err most alike, in order."""
    pairs = ensemble.pairwise_errors(A.patterns(spark, sf), X.N).where("a < b").select("a", "b", "jaccard")
    return ranking.rank_all(pairs, (F.desc("jaccard"), "a", "b")).orderBy("rank").limit(5)


_TRAIN = f"{A._D('sum(tp) OVER w - tp')} / nullif(sum(tp) OVER w - tp + sum(fp) OVER w - fp + sum(fn) OVER w - fn, 0)"


@query(f"WITH {A._pairs_sql()} SELECT a, b, w10, scene AS held_out, bin, tp, fp, fn, round(iou, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY train DESC NULLS LAST, a, b, w10, bin) AS rk FROM (SELECT *, round({_TRAIN}, 9) AS train FROM io WINDOW w AS (PARTITION BY a, b, w10, bin))) WHERE rk = 1")
def weighted_pair_choice(spark, sf):
    """Pair, weight and threshold, chosen together on the other scenes."""
    curves = ensemble.weighted_pair_curves(X.pxw_valid(spark, sf, "scene", "y", *A.SCORES), A.SCORES, 100)
    return ensemble.loo_tuned(curves, ("a", "b", "w10"), joint=True)


@query()
def logreg_stacker_tuned(spark, sf):
    """The logistic stacker at thresholds tuned on the other scenes."""
    x = ensemble.logistic_stacker(X.pxw_valid(spark, sf, "scene", "y", *A.SCORES), A.SCORES)
    return ensemble.loo_tuned(auc.score_curves(x, ["scene"], 100))


@query(f"WITH {PXV_SQL}, h AS (SELECT *, (pix * 7919 + scene * 104729) % 1000003 AS h FROM pxv) SELECT scene, pix, y FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY h, pix) AS n FROM h) WHERE n <= 50")
def scene_subsample(spark, sf):
    x = X.pxw_valid(spark, sf, "scene", "pix", "y").select("scene", "pix", "y")
    return sampling.subsample(x, ("scene",), ("pix",), 50, order=F.expr("(pix * 7919 + scene * 104729) % 1000003"))


_GX, _GY = [-28.0, -18.0, -8.0], [-33.0, -25.0]


@query(f"""WITH {PXV_SQL}, s AS (SELECT y, count(*) AS n, var_samp(vv) AS xx, var_samp(vh) AS yy, covar_samp(vv, vh) AS xy FROM pxv GROUP BY y HAVING count(*) >= 100),
t AS (SELECT *, sqrt(det * f2 / yy) / 32 AS sx, sqrt(det * f2 / xx) / 32 AS sy FROM (SELECT *, pow(n, -1.0 / 3) AS f2, xx * yy - xy * xy AS det FROM s)), g AS (SELECT * FROM (SELECT unnest({_GX}) AS at_x), (SELECT unnest({_GY}) AS at_y)),
u AS (SELECT t.*, vv / sx - floor(vv / sx) AS fu, vh / sy - floor(vh / sy) AS fv, floor(vv / sx) AS i, floor(vh / sy) AS j FROM pxv p JOIN t ON t.y = p.y),
w AS (SELECT y, n, xx, yy, xy, f2, det, (i + a) * sx AS px, (j + b) * sy AS py, sum((CASE WHEN a = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN b = 1 THEN fv ELSE 1 - fv END)) AS w FROM u, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) GROUP BY ALL)
SELECT y, CAST(at_x AS DOUBLE) AS at_x, CAST(at_y AS DOUBLE) AS at_y, round(sum(w * exp(-((at_x - px) * (at_x - px) * yy - 2 * (at_x - px) * (at_y - py) * xy + (at_y - py) * (at_y - py) * xx) / (det * f2) / 2)) / max(n * 6.283185307179586 * sqrt(det) * f2), 7) AS density
FROM w, g GROUP BY ALL""")
def kde_2d(spark, sf):
    return sampling.kde2(X.pxw_valid(spark, sf, "y", "vv", "vh"), ["y"], "vv", "vh", _GX, _GY).withColumn("density", F.round("density", 7))


@query(f"WITH {A._FINE} SELECT model_name, bin, n, pos, round(sum_p, 6) AS sum_p FROM fh")
def fine_hist_merged(spark, sf):
    """Histograms of two halves of the scenes, merged."""
    x = X.px(spark, sf)
    halves = [calibration.fine_histogram(x.where(F.col("scene") % 2 == k), ["model_name"]) for k in (0, 1)]
    return calibration.merge(*halves, ["model_name"]).withColumn("sum_p", F.round("sum_p", 6))


@query(f"WITH {A._SWEEP} SELECT model_name, scene, threshold, iou FROM sw WHERE t_idx IN (30, 35, 70)")
def thresholds_met(spark, sf):
    """Rows of a sweep at thresholds that are sums of steps, not their literals."""
    wanted = spark.createDataFrame([(0.1 + 0.2,), (0.35,), (0.1 * 7,)], "threshold double")
    return ranking.near_threshold(A.sweep_of(spark, sf), wanted).select("model_name", "scene", "threshold", "iou")


@query(f"{A._SUMMARY and 'WITH ' + A._SUMMARY}, b AS (SELECT model_name, t_idx FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY iou_mean DESC, t_idx) AS rk FROM sm WHERE iou_mean IS NOT NULL) WHERE rk = 1) SELECT sw.model_name, sw.scene, sw.threshold, sw.precision, sw.recall FROM sw JOIN b ON b.model_name = sw.model_name AND b.t_idx = sw.t_idx WHERE sw.model_name <> 'm0'")
def operating_points(spark, sf):
    """Precision and recall at each model's best threshold; a model without one is left out."""
    from gridmetric.operators import sweep

    rows = A.sweep_of(spark, sf)
    best = sweep.best_threshold(sweep.sweep_summary(rows)).where("metric = 'iou' AND model_name <> 'm0'").select("model_name", "t_idx")
    return rows.join(best, ["model_name", "t_idx"]).select("model_name", "scene", "threshold", "precision", "recall")


@query("SELECT user_id AS name, min(event_id) AS first_at FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY user_id")
def common_pairs(spark, sf):
    e = X.log(spark, sf)
    first = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("name")).agg(F.min("event_id").alias("first_at"))
    return ranking.common_pairs(first, e.where("event_type = 'click'").select(F.col("user_id").alias("name")), "name", "first_at")


@query(f"{_PAIRS}, x AS (SELECT model, round(max(iou), 3) AS e FROM p GROUP BY model) SELECT x.model, round(min(abs(e - iou)), 9) AS distance, min(abs(e - iou)) <= 0.0002 AS ok FROM x JOIN p ON p.model = x.model GROUP BY x.model")
def sanity_gate(spark, sf):
    measured = _pairs(spark, sf).select("model", "iou")
    expected = measured.groupBy("model").agg(F.round(F.max("iou"), 3).alias("iou"))
    return ranking.sanity_gate(measured, expected, ["model"], tolerance=2e-4)


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS views FROM f GROUP BY user_id")
def ordered_dedupe(spark, sf):
    """Each user's event types in order, each once."""
    seen = X.log(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return seen.select("user_id", F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_type"])), ",").alias("views"))


# Alignment

_AFF = "SELECT user_id AS scene, user_id % 2 = 0 AS geo, CAST(user_id % 60 AS DOUBLE) AS lat, user_id % 7 AS k, user_id % 5 AS s FROM (SELECT DISTINCT user_id FROM events)"
_DIFF = """d AS (SELECT *, k * 0.001 AS dc, k * 0.002 AS df, CASE WHEN geo THEN abs(111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat))) ELSE 1 END AS mx,
CASE WHEN geo THEN abs(111132.92 - 559.82 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat))) ELSE 1 END AS my FROM a)"""


def _transforms(spark, sf):
    u = X.log(spark, sf).select(F.col("user_id").alias("scene")).distinct()
    u = u.select("scene", (F.col("scene") % 2 == 0).alias("geo"), (F.col("scene") % 60).cast("double").alias("lat"), (F.col("scene") % 7).alias("k"), (F.col("scene") % 5).alias("s"))
    base = [F.lit(x) for x in (0.01, 0.0, 100.0, 0.0, -0.01, 50.0)]
    other = [*base[:2], F.lit(100.0) + F.col("k") * 0.001, *base[3:5], F.lit(50.0) + F.col("k") * 0.002]
    return u.withColumn("base", F.array(*base)).withColumn("other", F.array(*other))


@query(f"WITH a AS ({_AFF}), {_DIFF} SELECT scene, round(df, 9) AS max_abs_diff, round(greatest(dc * mx, df * my), 4) AS max_diff_m, round(greatest(dc / 0.01, df / 0.01), 6) AS max_diff_px FROM d")
def transform_diffs(spark, sf):
    x = overlay.transform_diff(_transforms(spark, sf), "base", "other", F.col("geo"), F.col("lat"))
    return x.select("scene", F.round("max_abs_diff", 9).alias("max_abs_diff"), F.round("max_diff_m", 4).alias("max_diff_m"), F.round("max_diff_px", 6).alias("max_diff_px"))


@query(f"WITH a AS ({_AFF}) SELECT scene, CASE WHEN s = 1 THEN 'crs_mismatch' WHEN s = 2 THEN 'shape_mismatch' WHEN k * 0.2 > 0.5 THEN 'transform_mismatch' ELSE 'aligned' END AS status FROM a")
def alignment_checks(spark, sf):
    x = overlay.transform_diff(_transforms(spark, sf), "base", "other", F.col("geo"), F.col("lat"))
    x = x.withColumn("crs_a", F.lit("EPSG:32748")).withColumn("crs_b", F.when(F.col("s") == 1, "EPSG:4326").otherwise("EPSG:32748"))
    x = x.withColumn("shape_a", F.lit("224x224")).withColumn("shape_b", F.when(F.col("s") == 2, "224x223").otherwise("224x224"))
    return manifest.alignment_status(x).select("scene", "status")


@query(f"WITH a AS ({_AFF}) SELECT scene, CAST(floor((3.2 * k) / 10 + 0.5) AS INT) AS row_off, CAST(floor((4.1 * s) / 10 + 0.5) AS INT) AS col_off, 40 AS height, CAST(floor((300.0 - 10 * s) / 10 + 0.5) AS INT) AS width FROM a")
def bounds_window(spark, sf):
    """Window of each scene's extent in a larger raster of 10 m pixels, offsets and lengths rounded."""
    x = _transforms(spark, sf).withColumn("out_left", F.lit(1000.0)).withColumn("out_top", F.lit(5000.0))
    x = x.withColumn("in_left", F.col("out_left") + 4.1 * F.col("s")).withColumn("in_top", F.col("out_top") - 3.2 * F.col("k"))
    x = x.withColumn("in_right", F.col("in_left") + 300.0 - 10 * F.col("s")).withColumn("in_bottom", F.col("in_top") - 400.0)
    return manifest.bounds_window(x, "in", "out", 10.0).select("scene", "row_off", "col_off", "height", "width")


@query(f"WITH {P._STITCH}, cell AS (SELECT CAST(k // 30 AS INT) - 10 AS r, CAST(k % 30 AS INT) - 10 AS c FROM (SELECT unnest(range(0, 900)) AS k)) SELECT cell.r, cell.c, coalesce(round(p, 8), 0.25) AS vv, coalesce(round(-p, 8), -0.5) AS vh FROM cell LEFT JOIN st ON st.r = cell.r AND st.c = cell.c")
def channel_fills(spark, sf):
    """Two bands read beyond the raster's edge, each filled with its channel's training mean."""
    st = tiles.stitch_weighted(P.pixels(spark, sf), 8).select("r", "c", F.round("p", 8).alias("vv"), F.round(-F.col("p"), 8).alias("vh"))
    cells = spark.range(900).selectExpr("CAST(id div 30 AS INT) - 10 AS r", "CAST(id % 30 AS INT) - 10 AS c")
    fills = manifest.channel_fills("training_channel_mean", [0.25, -0.5], 2)
    return tiles.boundless_read(st, cells, dict(zip(("vv", "vh"), fills)), ("r", "c"))


def _near_mean(crops):
    """Sigmoid of the mean of each pixel and its eight neighbours, zeros beyond the window."""
    n = np.pad(crops, ((0, 0), (1, 1), (1, 1)))
    h, w = crops.shape[1:]
    return 1 / (1 + np.exp(-sum(n[:, a : a + h, b : b + w] for a in range(3) for b in range(3)) / 9))


@query(f"""WITH {P._STITCH}, size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM st), cell AS (SELECT CAST(k // w AS INT) AS r, CAST(k % w AS INT) AS c FROM (SELECT w, unnest(range(0, h * w)) AS k FROM size)),
near AS (SELECT r, c, r + dr AS nr, c + dc AS nc FROM cell, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc))
SELECT 0 AS scene, near.r, near.c, round(1 / (1 + exp(-sum(coalesce(st.p, 0)) / 9)), 6) AS p FROM near LEFT JOIN st ON st.r = near.nr AND st.c = near.nc GROUP BY ALL""")
def scene_inference(spark, sf):
    """Scores of a canvas by a scorer that sees a pixel's neighbours, in buffered and overlapping windows and four views, over blocks that exchange
    halos: as if the scorer had seen the whole canvas at once."""
    canvas = P._canvas(spark, sf)
    grid = blocks.raster_blocks(canvas, blocks.scene_sizes(canvas), 48, "p")
    views = ("identity", "hflip", "vflip", "hvflip")
    scored = blocks.scene_inference(grid, 48, 32, _near_mean, stride=24, buffer=4, views=views)
    return blocks.block_pixels(scored, 48, "p").withColumn("p", F.round("p", 6))


_WINDOWS = "CAST(scene % 7 - 3 AS INT) AS row_off, CAST(scene % 5 - 2 AS INT) AS col_off"


@query(f"""WITH {P._SCENE_STITCH}, win AS (SELECT scene, {_WINDOWS} FROM (SELECT DISTINCT scene FROM st)), cell AS (SELECT scene, row_off, col_off, CAST(k // 50 AS INT) AS r, CAST(k % 50 AS INT) AS c FROM win, (SELECT unnest(range(0, 2000)) AS k))
SELECT cell.scene, cell.r, cell.c, round(CASE WHEN st.p IS NOT NULL THEN st.p WHEN r + row_off >= 0 AND r + row_off < h AND c + col_off >= 0 AND c + col_off < w THEN NULL ELSE -9 END, 6) AS p
FROM cell JOIN (SELECT scene, max(r) + 1 AS h, max(c) + 1 AS w FROM st GROUP BY scene) USING (scene) LEFT JOIN st ON st.scene = cell.scene AND st.r = cell.r + row_off AND st.c = cell.c + col_off""".replace("WHEN r + row_off >= 0 AND r + row_off < h AND c + col_off", "WHEN cell.r + row_off >= 0 AND cell.r + row_off < h AND cell.c + col_off").replace("AND c + col_off < w", "AND cell.c + col_off < w"))
def window_read(spark, sf):
    """Pixels of each scene's raster in the window of another raster's bounds: 40 x 50 pixels that may begin outside, where they read -9."""
    chips = X.chips(spark, sf)
    canvas = tiles.stitch_weighted(tiles.tile_pixels(chips, 8), 8, keys=("scene",))
    grid = blocks.raster_blocks(canvas, blocks.scene_sizes(canvas), 32, "p")
    bounds = chips.select("scene").distinct().selectExpr("scene", _WINDOWS.partition(",")[0], _WINDOWS.partition(",")[2]).withColumns({"out_left": F.lit(1000.0), "out_top": F.lit(5000.0)})
    bounds = bounds.withColumns({"in_left": F.col("out_left") + 10 * F.col("col_off"), "in_top": F.col("out_top") - 10 * F.col("row_off")})
    bounds = bounds.withColumns({"in_right": F.col("in_left") + 500.0, "in_bottom": F.col("in_top") - 400.0}).drop("row_off", "col_off")
    windows = manifest.bounds_window(bounds, "in", "out", 10.0).select("scene", "row_off", "col_off", "height", "width")
    read = blocks.block_pixels(blocks.read_window(grid, windows, 32, "p", boundless=True, fill=-9.0), 32, "p")
    return read.select("scene", "r", "c", F.round(F.when(~F.isnan("p"), F.col("p")), 6).alias("p"))


@query()
def bootstrap_full_size(spark, sf):
    """A thousand replicates of each scene's pixels, each as large as the scene: means and percentiles of the metrics over replicates."""
    x = X.pxw_valid(spark, sf, "scene", "y", "p_2")
    counts = metrics.confusion_counts(x, ["scene"], F.col("y"), S.threshold_probability("p_2", 0.5))
    m = metrics.binary_metrics()
    draws = sampling.bootstrap_counts(counts, ["scene"], 1000).select("scene", m["iou"].alias("iou"), m["f1"].alias("f1"))
    return sampling.bootstrap_summary(draws, ["scene"], ("iou", "f1"))


@query(f"{P._LINES}, s AS (SELECT contour_id, len(x) AS n, contour_id % 3 AS kind, CAST(contour_id % 60 AS DOUBLE) AS lat, x, y FROM l WHERE len(x) >= 2), m AS (SELECT *, CASE WHEN kind = 0 THEN abs(111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat))) ELSE 1 END AS mx, CASE WHEN kind = 0 THEN abs(111132.92 - 559.82 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat))) ELSE 1 END AS my FROM s) SELECT contour_id, round(CASE WHEN kind <> 2 THEN list_sum([sqrt(pow((x[k + 1] - x[k]) * mx, 2) + pow((y[k + 1] - y[k]) * my, 2)) for k in range(1, len(x))]) END, 3) AS metres, CASE kind WHEN 0 THEN 'geographic' WHEN 1 THEN 'projected' ELSE 'no_crs' END AS reason FROM m")
def metric_lengths(spark, sf):
    """Lengths in metres of lines in degrees and in projected units; without a coordinate system null, with the reason."""
    x = P._lines(spark, sf).where(F.size("vertices") >= 2).withColumn("kind", F.col("contour_id") % 3).withColumn("lat", (F.col("contour_id") % 60).cast("double"))
    metres = F.when(F.col("kind") != 2, geometry.metric_length(F.col("kind") == 0, F.col("lat")))
    reason = F.when(F.col("kind") == 0, "geographic").when(F.col("kind") == 1, "projected").otherwise("no_crs")
    return x.select("contour_id", F.round(metres, 3).alias("metres"), reason.alias("reason"))


# Manifests and configurations

_SEEDS = {"s42": 8, "s43": 7, "s44": 7}  # checkpoints of each seed's grid
_STRIDES = (56, 112, 224)


def _checkpoints(spark):
    return spark.createDataFrame([(f"{s}_ckpt{k}",) for s, n in _SEEDS.items() for k in range(n)], "checkpoint string")


_SWEEP_SQL = f"SELECT image, checkpoint, preset, checkpoint || '__' || preset || '__' || image AS run_id FROM (SELECT DISTINCT 'scene' || user_id % 6 AS image FROM events), (SELECT unnest({[f'{s}_ckpt{k}' for s, n in _SEEDS.items() for k in range(n)]}) AS checkpoint), (SELECT unnest({[f'stride{k}' for k in _STRIDES]}) AS preset)"


def _sweep(spark, sf):
    images = X.log(spark, sf).select(F.concat(F.lit("scene"), (F.col("user_id") % 6).cast("string")).alias("image")).distinct()
    presets = spark.createDataFrame([(f"stride{k}",) for k in _STRIDES], "preset string")
    return manifest.expand_sweep(_checkpoints(spark), presets, images)


@query(_SWEEP_SQL)
def site_sweep(spark, sf):
    """Every checkpoint of three seeds with every stride and image."""
    return _sweep(spark, sf)


_STATUS = "CASE WHEN image = 'scene3' AND preset = 'stride56' THEN 'failed' ELSE 'success' END"


@query(f"WITH m AS (SELECT *, {_STATUS} AS status FROM ({_SWEEP_SQL})) SELECT checkpoint, preset, count(*) AS n_images, CASE WHEN bool_and(status = 'success') THEN 'evaluate' ELSE 'skipped_incomplete_group' END AS entry FROM m GROUP BY ALL")
def evaluation_entries(spark, sf):
    """Groups of a manifest whose runs all succeeded, for the evaluation's configuration."""
    runs = _sweep(spark, sf).withColumn("status", F.expr(_STATUS)).withColumn("return_code", F.lit(0))
    return manifest.evaluation_entries(runs, ["checkpoint", "preset"])


@query("SELECT event_id, k.key, CASE WHEN k.key = 'data.batch' AND event_id % 3 = 0 THEN CAST(event_id % 64 AS VARCHAR) WHEN k.key = 'mode' AND event_id % 4 = 0 THEN event_type ELSE k.value END AS value FROM events, (VALUES ('data.batch', '32'), ('data.root', '/d'), ('mode', 'fast')) k(key, value)")
def merged_overrides(spark, sf):
    """Each run's configuration: the defaults with the run's own values over them; unset ones change nothing."""
    run = X.log(spark, sf).withColumns({"batch": F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 64).cast("string")), "mode": F.when(F.col("event_id") % 4 == 0, F.col("event_type"))})
    return manifest.merged_settings(run, "event_id", {"data": {"root": "/d", "batch": 32}, "mode": "fast"}, {"data.batch": "batch", "mode": "mode"})


@query("SELECT 'r' || user_id % 5 AS run_id, 's' || event_id AS scene_id, 'r' || user_id % 5 || '/s' || event_id || '/s' || event_id || '_probability' AS path, 'grid' AS tool, event_type AS mode, event_type || ' success' AS summary FROM events")
def provenance_rows(spark, sf):
    runs = X.log(spark, sf).select(F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("run_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("scene_id"), F.col("event_type").alias("mode"), F.lit("success").alias("status"))
    p = manifest.provenance(runs, "probability", {"tool": "grid"})
    return p.select("run_id", "scene_id", "path", p.tags["tool"].alias("tool"), p.tags["mode"].alias("mode"), "summary")


@query("SELECT user_id, regexp_replace(event_type || ' ' || user_id || '/x', '[^A-Za-z0-9.-]', '_', 'g') AS folder, CASE WHEN length(event_type || '-' || user_id) > 8 THEN substring(event_type || '-' || user_id, 1, 7) || '…' ELSE event_type || '-' || user_id END AS short FROM events")
def name_helpers(spark, sf):
    e = X.log(spark, sf)
    name = F.concat_ws("-", "event_type", "user_id")
    return e.select("user_id", manifest.safe_dirname(F.concat(F.col("event_type"), F.lit(" "), F.col("user_id"), F.lit("/x"))).alias("folder"), manifest.shorten(name, 8).alias("short"))


_LOOP = tuple(f"m{k}" for k in range(X.N))


@query(f"WITH {PX_SQL}, c AS (SELECT model_name, count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y <> 1 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND NOT p > 0.5) AS fn FROM px GROUP BY model_name), i AS (SELECT model_name, round(CAST(tp AS DOUBLE) / (tp + fp + fn), 9) AS iou FROM c) SELECT *, row_number() OVER (ORDER BY iou DESC, model_name) AS rank FROM i")
def interleaved_benchmark(spark, sf):
    """Every checkpoint in turn, each scored, evaluated and cleaned before the next; then ranked."""
    root = shared.scratch_folder(spark, "benchmark")

    def infer(name):
        X.px(spark, sf).where(F.col("model_name") == name).write.parquet(f"{root}/scores/{name}")
        return spark.read.parquet(f"{root}/scores/{name}")

    def evaluate(rows):
        c = metrics.confusion_counts(rows, ["model_name"], F.col("y"), S.threshold_probability("p", 0.5))
        return metrics.with_columns(c, {"iou": metrics.binary_metrics()["iou"]}).select("model_name", "iou")

    def keep(rows, name):
        rows.write.parquet(f"{root}/results/{name}")
        return spark.read.parquet(f"{root}/results/{name}")

    return manifest.benchmark_loop(_LOOP, infer, evaluate, lambda n: shared.clean_up(spark, [f"{root}/scores/{n}"]), lambda rows: ranking.rank_all(rows, (F.desc("iou"), "model_name")), keep)


# Sources and sinks

_COUNTS = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


@query(_COUNTS)
def csv_summary(spark, sf):
    """A result table written as one CSV file with a header, read with its fixed schema."""
    path = shared.scratch_folder(spark, "csv")
    files.write_csv(ranking.value_counts(X.log(spark, sf), "event_type"), path)
    return files.read_csv(spark, path, "event_type string, n long", ("event_type", "n"))


@query(f"{R._BOOT} SELECT * FROM s")
def bootstrap_samples(spark, sf):
    """Replicates kept as Parquet."""
    path = shared.scratch_folder(spark, "samples")
    R._boot(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT user_id AS run, event_type AS status, CASE WHEN event_type = 'view' THEN '' ELSE 'e' || event_id END AS message, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS minutes FROM events WHERE event_type IN ('view', 'click')")
def manifest_append(spark, sf):
    """Rows appended in a fixed order of columns; what a batch lacks is empty text or null."""
    path, e = shared.scratch_folder(spark, "manifest"), X.log(spark, sf)
    schema = "run long, status string, message string, minutes double"
    files.append_manifest(e.where("event_type = 'view'").select(F.col("event_type").alias("status"), F.col("user_id").alias("run")), path, schema)
    more = e.where("event_type = 'click'").select(F.col("user_id").alias("run"), F.col("event_type").alias("status"), F.concat(F.lit("e"), F.col("event_id")).alias("message"), F.col("value").alias("minutes"))
    files.append_manifest(more, path, schema)
    return spark.read.schema(schema).parquet(path)


@query(_COUNTS)
def written_once(spark, sf):
    """A run's configuration is written once; a later one is ignored."""
    path, first = shared.scratch_folder(spark, "once"), ranking.value_counts(X.log(spark, sf), "event_type")
    files.write_once(first, path)
    files.write_once(first.limit(0), path)
    return spark.read.parquet(path)


@query("SELECT CAST(user_id % 3 AS BIGINT) AS run_id, event_type AS scene_id, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def scene_output(spark, sf):
    """Rows by run and scene, read back from their partitions."""
    path = shared.scratch_folder(spark, "scenes")
    files.write_scene_output(X.log(spark, sf).select((F.col("user_id") % 3).alias("run_id"), F.col("event_type").alias("scene_id"), "value"), path)
    back = spark.read.schema("value double, run_id long, scene_id string").parquet(path)
    return back.groupBy("run_id", "scene_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"WITH {PXW_SQL} SELECT scene, CAST(CASE WHEN ref = 255 THEN 255 WHEN p_0 >= 0.5 THEN 1 ELSE 0 END AS SMALLINT) AS mask, count(*) AS n FROM pxw GROUP BY ALL")
def binary_masks(spark, sf):
    """Masks at or above a threshold, 255 where there is no data, written by scene."""
    path = shared.scratch_folder(spark, "masks")
    mask = F.when(F.col("ref") == 255, 255).otherwise(F.when(F.col("p_0") >= 0.5, 1).otherwise(0)).cast("smallint")
    X.pxw(spark, sf, "scene", "pix", "ref", "p_0").select("scene", "pix", mask.alias("mask")).write.partitionBy("scene").parquet(path)
    return spark.read.parquet(path).groupBy("scene", "mask").agg(F.count("*").alias("n"))


@query(f"WITH {PXV_SQL} SELECT scene, CAST(CASE WHEN scene < 1995 THEN 9 WHEN y = 1 AND p_0 > 0.5 THEN 1 WHEN y = 0 AND p_0 > 0.5 THEN 2 WHEN y = 1 THEN 3 ELSE 4 END AS INT) AS code, count(*) AS n FROM pxv GROUP BY ALL")
def confusion_rasters(spark, sf):
    """Confusion codes by scene; scenes that are there already (here with code 9) are skipped."""
    path = shared.scratch_folder(spark, "confusion")
    x = X.pxw_valid(spark, sf, "scene", "pix", "y", "p_0")
    x.where("scene < 1995").select("scene", "pix", F.lit(9).alias("code")).write.partitionBy("scene").parquet(path)
    code = S.confusion_code("y", S.threshold_probability("p_0", 0.5)).cast("int")
    shared.write_missing(x.select("scene", "pix", code.alias("code")), path, ["scene"])
    return spark.read.parquet(path).groupBy("scene", "code").agg(F.count("*").alias("n"))


_CONS = f"w AS (SELECT scene, {A._wrong_sql(A._TUNED)} AS n_wrong FROM pxv)"


@query(f"WITH {PXV_SQL}, {_CONS} SELECT scene, CAST(sum(n_wrong) AS BIGINT) AS wrong, count(*) FILTER (n_wrong = {X.N}) AS all_wrong, count(*) FILTER (n_wrong >= {X.N - 2}) AS most_wrong, {sum(A._TUNED):.2f} AS thresholds FROM w GROUP BY scene")
def consensus_bands(spark, sf):
    """Three bands of consensus errors by scene, with the thresholds they rest on as a table of their own."""
    root = shared.scratch_folder(spark, "consensus")
    x = ensemble.consensus_errors(X.pxw_valid(spark, sf, "scene", "pix", "y", *A.SCORES), A.SCORES, A._TUNED)
    bands = x.select("scene", "pix", F.col("n_wrong_tuned").cast("smallint").alias("band1"), F.col("all_wrong").cast("smallint").alias("band2"), F.col("most_wrong").cast("smallint").alias("band3"))
    bands.write.partitionBy("scene").parquet(f"{root}/bands")
    files.write_csv(spark.createDataFrame(list(zip(A.SCORES, A._TUNED)), "member string, threshold double"), f"{root}/thresholds")
    cuts = files.read_csv(spark, f"{root}/thresholds", "member string, threshold double").agg(F.round(F.sum("threshold"), 2).alias("thresholds"))
    sums = spark.read.parquet(f"{root}/bands").groupBy("scene").agg(F.sum("band1").alias("wrong"), F.sum("band2").alias("all_wrong"), F.sum("band3").alias("most_wrong"))
    return sums.join(F.broadcast(cuts), F.lit(True))  # one row


@query(f"{P._LINES} SELECT contour_id, len(x) AS n, x[1] AS first_x, 'LineString' AS kind FROM l")
def geojson_features(spark, sf):
    """Lines as GeoJSON features, one a row of text, read back."""
    path = shared.scratch_folder(spark, "geojson")
    files.geojson_lines(P._lines(spark, sf)).write.text(path)
    shape = "type string, properties struct<contour_id: long>, geometry struct<type: string, coordinates: array<array<double>>>"
    f = spark.read.schema(shape).json(path)
    return f.select("properties.contour_id", F.size("geometry.coordinates").cast("long").alias("n"), F.get(F.get("geometry.coordinates", F.lit(0)), F.lit(0)).alias("first_x"), F.col("geometry.type").alias("kind"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def checked_copy(spark, sf):
    """A copy that is read again and compared before it counts."""
    path = shared.scratch_folder(spark, "copy")
    files.validated_copy(X.log(spark, sf).select("event_id", "event_type"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event_type AS run, count(*) AS scenes, [min(value), max(value)] AS bounds FROM events GROUP BY event_type".replace("[min(value), max(value)] AS bounds", "min(value) AS low, max(value) AS high"))
def run_metadata(spark, sf):
    """Metadata of runs as JSON text, read with a schema."""
    path = shared.scratch_folder(spark, "metadata")
    m = X.log(spark, sf).groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("scenes"), F.array(F.min("value"), F.max("value")).alias("bounds"))
    m.select(F.col("run").alias("folder"), F.to_json(F.struct("*")).alias("value")).repartition("folder").write.partitionBy("folder").text(path)  # a document a run
    back = files.read_scene_metadata(spark, path, "run string, scenes long, bounds array<double>")
    return back.select("run", "scenes", F.get("bounds", F.lit(0)).alias("low"), F.get("bounds", F.lit(1)).alias("high"))


@query(f"SELECT scene, height, width, CAST(height AS BIGINT) * width * 4 AS bytes FROM {P._SCENES}")
def scene_catalog(spark, sf):
    """Catalogue of scenes from their JSON sidecars; the size of a raw raster follows from shape and precision."""
    path = shared.scratch_folder(spark, "sidecars")
    side = P.scenes(spark, sf).select("scene", F.array("height", "width").alias("shape"), F.lit("float32").alias("precision"))
    side.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    s = spark.read.schema("scene long, shape array<int>, precision string").json(path)
    height, width = F.get("shape", F.lit(0)), F.get("shape", F.lit(1))
    return s.select("scene", height.alias("height"), width.alias("width"), (height.cast("long") * width * F.when(F.col("precision") == "float32", 4).otherwise(8)).alias("bytes"))


@query("SELECT 'img' || event_id || '.tif' AS path FROM events WHERE event_id % 3 <> 0")
def listed_images(spark, sf):
    """Images that a list file names; blank lines and comments don't count."""
    path = shared.scratch_folder(spark, "list")
    name = F.concat(F.lit("img"), F.col("event_id"), F.lit(".tif"))
    line = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("# "), name)).when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("  "), name, F.lit(" ")))
    X.log(spark, sf).select(line.alias("value")).write.text(path)
    return files.input_images(spark, list_file=path)


@query("SELECT DISTINCT event_type AS scene FROM events")
def scene_listing(spark, sf):
    """Scenes of a folder tree, by the files that match in it."""
    path = shared.scratch_folder(spark, "tree")
    X.log(spark, sf).select("event_type", "value").write.partitionBy("event_type").parquet(path)
    return files.listing(spark, path, "*.parquet").select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("scene")).distinct()


_TILINGS = {"_native224": "native", "_whole": "whole"}


@query("SELECT 'runs/' || m || '/s' || user_id % 4 || '/p.tif' AS path, m AS model, 'net' || user_id % 3 AS base, CASE WHEN user_id % 2 = 0 THEN 'native' ELSE 'whole' END AS tiling, 's' || user_id % 4 AS scene FROM (SELECT user_id, 'net' || user_id % 3 || CASE WHEN user_id % 2 = 0 THEN '_native224' ELSE '_whole' END AS m FROM (SELECT DISTINCT user_id FROM events))")
def discovered_models(spark, sf):
    """Model, tiling and scene from the paths of a folder tree."""
    u = X.log(spark, sf).select("user_id").distinct()
    model = F.concat(F.lit("net"), F.col("user_id") % 3, F.when(F.col("user_id") % 2 == 0, "_native224").otherwise("_whole"))
    return files.discover(u.select(F.concat(F.lit("runs/"), model, F.lit("/s"), F.col("user_id") % 4, F.lit("/p.tif")).alias("path")), _TILINGS)


@query("SELECT event_id AS global_step, value AS loss FROM events")
def run_history(spark, sf):
    """A run's history by step, without private columns."""
    path = shared.scratch_folder(spark, "history")
    X.log(spark, sf).select(F.col("event_id").alias("global_step"), F.col("value").alias("loss"), F.col("ts").alias("_timestamp")).write.json(path)
    return files.read_history(spark, path)


@query("SELECT 'run_' || event_type AS run_name, count(*) AS n FROM events GROUP BY event_type")
def collated_summaries(spark, sf):
    """CSV summaries of several runs, with the run's name from its folder without the time stamp."""
    root, e = shared.scratch_folder(spark, "collate"), X.log(spark, sf)
    for kind in sorted(r[0] for r in e.select("event_type").distinct().collect()):  # a few runs
        files.write_csv(e.where(F.col("event_type") == kind).agg(F.count("*").alias("n")), f"{root}/run_{kind}__20240102T030405Z")
    return files.collate(spark, f"{root}/*", "n long").select("run_name", "n")


@query("SELECT 'late' AS folder, event_type, count(*) AS n FROM events GROUP BY event_type")
def newest_folder(spark, sf):
    """The results of the run that was written last."""
    import time

    root, e = shared.scratch_folder(spark, "newest"), X.log(spark, sf)
    for name, rows in (("zz_early", e.where("event_id % 2 = 0")), ("late", e)):
        rows.select("event_id", "event_type").write.parquet(f"{root}/{name}")
        time.sleep(0.02)  # file systems know times by the millisecond
    newest = shared.newest_folder(spark, root)
    return spark.read.parquet(f"{root}/{newest}").groupBy(F.lit(newest).alias("folder"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, event_type <> 'click' AS deleted, event_type = 'click' AS there FROM (SELECT DISTINCT event_type FROM events)")
def cleanup_report(spark, sf):
    """Outputs of all kinds but one are deleted, that one only reported; what is there afterwards is looked up."""
    path, e = shared.scratch_folder(spark, "cleanup"), X.log(spark, sf)
    e.select("event_type", "value").write.partitionBy("event_type").parquet(path)
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    report = shared.clean_up(spark, [f"{path}/event_type={k}" for k in kinds if k != "click"]).unionByName(shared.clean_up(spark, [f"{path}/event_type=click"], dry_run=True))
    after = shared.clean_up(spark, [f"{path}/event_type={k}" for k in kinds], dry_run=True)
    kind = F.regexp_extract("pattern", "event_type=(.*)$", 1)
    return report.select(kind.alias("event_type"), "deleted").join(after.select(kind.alias("event_type"), F.col("existed").alias("there")), "event_type")
