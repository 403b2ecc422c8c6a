"""Queries of overlays, joins, manifests, rankings, windows and set operations."""

from pyspark.sql import functions as F

from gridmetric.operators import blocks, overlay, ranking, sampling
from gridmetric.plans.registry import query
from gridmetric.sources import fixtures as X
from gridmetric.sources.fixtures import PXV_SQL, PXW_SQL
from gridmetric.sources.shared import Tables


def _rasters(spark, sf):
    grid = X.with_grid(X.pxw(spark, sf, "scene", "pix", "ref", "msk", "p_0"))
    n = X.lineitem(spark, sf).count()
    by_place = lambda d: ranking.deal(d, n, "scene", "r", "c")
    ref = grid.where("pix % 11 <> 0").select("scene", "r", "c", "ref")
    pred = overlay.shift_grid(grid.where("pix % 13 <> 0").select("scene", (F.col("r") + 3).alias("r"), (F.col("c") - 2).alias("c"), "p_0"), -3, 2)
    return by_place(ref), by_place(pred), by_place(grid.where("pix % 5 <> 0").select("scene", "r", "c", "msk"))


BLOCK, BUCKETS = 64, 8  # buckets at least; there are as many as the pixels need


def _stored(spark, sf, *bands):
    """Rasters of the bands in blocks of one grid, each stored for itself. Pixels that a band lacks are null."""
    there = {"ref": "pix % 11 <> 0", "p_0": "pix % 13 <> 0", "msk": "pix % 5 <> 0"}
    grid = X.with_grid(X.pxw(spark, sf, "scene", "pix", *bands))
    pixels = grid.select("scene", "r", "c", *[F.when(F.expr(there[b]), F.col(b)).alias(b) for b in bands])
    n = X.pxw(spark, sf, "scene").groupBy("scene").count()  # a scene's pixels fill rows of 100
    sizes = n.selectExpr("scene", "CAST((count - 1) div 100 + 1 AS INT) AS height", "CAST(least(count, 100) AS INT) AS width")
    every = X.lineitem(spark, sf).count()
    dealt = Tables(spark, "grid").keep(blocks.raster_blocks(pixels, sizes, BLOCK, *bands, rows=every))
    buckets = max(BUCKETS, ranking.tasks_for(every))
    return [blocks.store_blocks(dealt.select("scene", "by", "bx", "height", "width", b), buckets) for b in bands]


@query(f"WITH {PXW_SQL} SELECT scene, CAST(pix // 100 AS INT) AS r, CAST(pix % 100 AS INT) AS c, ref, p_0 FROM pxw WHERE pix % 11 <> 0 AND pix % 13 <> 0")
def overlay_inner(spark, sf):
    """Reference and prediction, stored by scene and block, meet block by block without an exchange."""
    ref, pred = _stored(spark, sf, "ref", "p_0")
    return blocks.overlay_blocks(ref, pred, BLOCK, values=("ref", "p_0"))


@query(f"WITH {PXW_SQL} SELECT scene, CAST(pix // 100 AS INT) AS r, CAST(pix % 100 AS INT) AS c, ref, p_0, CASE WHEN pix % 5 = 0 THEN 0 ELSE msk END AS msk FROM pxw WHERE pix % 11 <> 0 AND pix % 13 <> 0")
def overlay_mask_left(spark, sf):
    """The same with a mask, which reads 0 where it has no pixel."""
    ref, pred, mask = _stored(spark, sf, "ref", "p_0", "msk")
    return blocks.overlay_blocks(ref, pred, BLOCK, mask, ("ref", "p_0"), boundless=True)


@query(f"WITH {PXW_SQL} SELECT scene, CAST(pix // 100 AS INT) AS r, CAST(pix % 100 AS INT) AS c, ref, p_0, msk FROM pxw WHERE pix % 11 <> 0 AND pix % 13 <> 0 AND pix % 5 <> 0")
def overlay_mask_inner(spark, sf):
    """Pixels as rows, which needs an exchange by scene, row and column: the form for rasters that aren't stored."""
    ref, pred, mask = _rasters(spark, sf)
    return overlay.overlay(ref, pred, mask)


@query("WITH e AS (SELECT l_suppkey AS k, min(l_quantity) + l_suppkey % 40 AS l, min(l_extendedprice) AS b, max(l_quantity) - l_suppkey % 7 AS r, max(l_extendedprice) / 2 AS t FROM lineitem GROUP BY l_suppkey) SELECT x.k AS ka, y.k AS kb, greatest(x.l, y.l) AS left_, greatest(x.b, y.b) AS bottom, least(x.r, y.r) AS right_, least(x.t, y.t) AS top FROM e x JOIN e y ON x.k < y.k WHERE greatest(x.l, y.l) < least(x.r, y.r) AND greatest(x.b, y.b) < least(x.t, y.t)")
def bounds_intersection(spark, sf):
    k = F.col("l_suppkey")
    e = X.lineitem(spark, sf).groupBy("l_suppkey").agg(F.min("l_quantity").alias("q0"), F.min("l_extendedprice").alias("b"), F.max("l_quantity").alias("q1"), (F.max("l_extendedprice") / 2).alias("t"))
    e = e.select("l_suppkey", (F.col("q0") + k % 40).alias("l"), "b", (F.col("q1") - k % 7).alias("r"), "t")
    found = overlay.overlapping_extents(e.select("l_suppkey", F.col("l").alias("left_"), "b", F.col("r").alias("right_"), "t"), "l_suppkey", ("left_", "b", "right_", "t"))
    return found.select(F.col("a_l_suppkey").alias("ka"), F.col("b_l_suppkey").alias("kb"), "left_", F.col("b").alias("bottom"), "right_", F.col("t").alias("top"))


_SPREAD_COLUMNS = [
    "event_id AS k", "CAST(event_id * 7919 % 100003 AS DOUBLE) AS x", "CAST(event_id * 104729 % 100019 AS DOUBLE) AS y",
    "CAST(CASE WHEN event_id % 500 = 0 THEN 9000.5 WHEN event_id % 50 = 0 THEN 800.5 ELSE 60.5 END AS DOUBLE) AS w", "CAST(CASE WHEN event_id % 300 = 0 THEN 5000.5 ELSE 40.5 + event_id % 7 END AS DOUBLE) AS h",
]
_SPREAD = ", ".join(_SPREAD_COLUMNS)


@query(f"WITH e AS (SELECT k, x, y, x + w AS r, y + h AS t FROM (SELECT {_SPREAD} FROM events)) SELECT a.k AS ka, b.k AS kb, greatest(a.x, b.x) AS left_, greatest(a.y, b.y) AS bottom, least(a.r, b.r) AS right_, least(a.t, b.t) AS top FROM e a JOIN e b ON a.x < b.r AND b.x < a.r AND a.y < b.t AND b.y < a.t AND a.k < b.k")
def sparse_extents(spark, sf):
    """Extents of very different sizes over a wide plane, of which few overlap."""
    e = X.log(spark, sf).selectExpr(*_SPREAD_COLUMNS).selectExpr("k", "x AS left_", "y AS bottom", "x + w AS right_", "y + h AS top")
    return overlay.overlapping_extents(e, "k", ("left_", "bottom", "right_", "top")).withColumnsRenamed({"a_k": "ka", "b_k": "kb"})


@query("SELECT m.user_id AS model, s.scene FROM (SELECT DISTINCT user_id FROM events) m CROSS JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS scene FROM lineitem) s")
def models_x_scenes(spark, sf):
    m = X.log(spark, sf).select(F.col("user_id").alias("model")).distinct()
    return m.crossJoin(X.lineitem(spark, sf).select(F.year("l_shipdate").alias("scene")).distinct())


@query("WITH w AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t) SELECT user_id, event_type, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.event_type = w.event_type AND e.value > 480) THEN 'success' ELSE 'missing_prediction' END AS status FROM w")
def missing_prediction_anti(spark, sf):
    e = X.log(spark, sf)
    wanted = e.select("user_id").distinct().crossJoin(e.select("event_type").distinct())
    return ranking.missing_predictions(wanted, e.where("value > 480").select("user_id", "event_type"), ("user_id", "event_type"))


#: Mean value of each run in units of 500, rounded to 7 places. Values are whole hundredths, so integers give the same half-way cases in any engine.
_RUNS = """
SELECT user_id, event_type, ((2 * 10000000 * s + 50000 * n) // (2 * 50000 * n)) / 10000000.0 AS iou
FROM (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS s, count(*) AS n FROM events GROUP BY ALL)
"""


def _runs(spark, sf):
    sums = X.log(spark, sf).groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"), F.count("*").alias("n"))
    return sums.select("user_id", "event_type", (F.expr("(2 * 10000000 * s + 50000 * n) div (2 * 50000 * n)") / 10000000.0).alias("iou"))


@query(f"WITH r AS ({_RUNS}), d AS (SELECT a.event_type, a.iou - b.iou AS delta FROM r a JOIN r b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type <> 'view') SELECT event_type, count(*) AS n_pairs, round(avg(delta), 11) AS delta_mean, round(median(delta), 11) AS delta_median, round(stddev_samp(delta), 11) AS delta_std, round(min(delta), 11) AS delta_min, round(max(delta), 11) AS delta_max, count(*) FILTER (delta > 0) AS n_better FROM d GROUP BY event_type")
def paired_deltas(spark, sf):
    return ranking.paired_deltas(_runs(spark, sf), ("user_id",), "event_type", "view", "iou", ("event_type",))


@query(f"WITH r AS ({_RUNS}) SELECT a.user_id, a.event_type AS base_preset, a.iou AS base_value, b.iou AS suffixed_value, round(b.iou - a.iou, 9) AS gain FROM r a JOIN r b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'click'")
def tta_gain(spark, sf):
    named = _runs(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "click", "view_tta_flip4").otherwise(F.col("event_type")))
    return ranking.suffix_gain(named, ("user_id",), "event_type", "_tta_flip4", "iou")


@query("WITH m AS (SELECT DISTINCT event_type AS e FROM events) SELECT a.e AS a, b.e AS b FROM m a JOIN m b ON a.e < b.e")
def model_pairs(spark, sf):
    m = X.log(spark, sf).select("event_type").distinct()
    a, b = m.select(F.col("event_type").alias("a")), m.select(F.col("event_type").alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


@query(f"WITH r AS ({_RUNS}), t AS (SELECT user_id, round(max(iou), 9) AS threshold FROM r WHERE user_id % 4 <> 0 GROUP BY user_id) SELECT r.user_id, event_type, threshold, CASE WHEN threshold IS NULL THEN 'skipped_no_loo_threshold' ELSE 'success' END AS status FROM r LEFT JOIN t ON r.user_id = t.user_id")
def threshold_lookup_status(spark, sf):
    r = _runs(spark, sf)
    t = r.where("user_id % 4 <> 0").groupBy("user_id").agg(F.round(F.max("iou"), 9).alias("threshold"))
    return ranking.threshold_lookup(r.select("user_id", "event_type"), t, ("user_id",))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return ranking.value_counts(X.log(spark, sf), "event_type")


@query("SELECT user_id, count(*) AS n_trials, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'purchase') AS best_value FROM events GROUP BY user_id")
def study_pivot(spark, sf):
    return ranking.study_pivot(X.log(spark, sf), ["view", "click", "purchase"], "user_id", "event_type", "value", "purchase")


@query("SELECT user_id, count(*) AS n, bool_and(event_type <> 'error' AND value < 499) AND bool_and(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CASE WHEN value > 498 THEN 1 ELSE 0 END END = 0, TRUE)) AS success FROM events GROUP BY user_id")
def group_success(spark, sf):
    e = X.log(spark, sf).select("user_id", F.when((F.col("event_type") != "error") & (F.col("value") < 499), "success").otherwise("failed").alias("status"), F.when(F.col("event_id") % 3 == 0, None).otherwise(F.when(F.col("value") > 498, 1).otherwise(0)).alias("return_code"))
    return ranking.group_success(e, ("user_id",))


@query(f"WITH {PXW_SQL} SELECT scene, count(*) AS n_pixels, count(*) FILTER (ref <> 255) AS n_reference, count(*) FILTER (msk = 1) AS n_mask, count(*) FILTER (ref <> 255 AND msk = 1) AS n_valid, count(*) FILTER (ref = 1 AND msk = 1) AS n_water, count(*) FILTER (ref = 0 AND msk = 1) AS n_land FROM pxw GROUP BY scene")
def overlap_diagnostics(spark, sf):
    return overlay.overlap_diagnostics(X.pxw(spark, sf, "scene", "ref", "msk"), ["scene"], F.col("ref"), F.col("msk"))


@query(f"WITH r AS ({_RUNS}) SELECT user_id, event_type, iou, row_number() OVER (ORDER BY iou DESC, user_id, event_type) AS rank FROM r")
def rank_global(spark, sf):
    return ranking.rank_rows(_runs(spark, sf), (), (F.desc("iou"), "user_id", "event_type"))


@query(f"WITH r AS ({_RUNS}) SELECT user_id, event_type, iou, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, event_type) AS rank FROM r")
def rank_within(spark, sf):
    return ranking.rank_rows(_runs(spark, sf), ("user_id",), (F.desc("iou"), "event_type"))


@query("WITH b AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, bin, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin DESC) AS BIGINT) AS suffix_sum FROM b")
def cumulative_suffix(spark, sf):
    b = X.log(spark, sf).groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))
    return ranking.cumulative_suffix(b, ("event_type",), "bin", "n")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, sf):
    return ranking.running_best(X.log(spark, sf), ("user_id",), ("ts", "event_id"), "value").select("user_id", "event_id", "best")


@query("""WITH m AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS i, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT event_type, i, n % 3 <> 0 AS ok, 25 AS anchor FROM m),
g AS (SELECT event_type, bool_or(ok) AS found, min(i) AS f, max(i) AS l, max(i) FILTER (i < anchor AND NOT ok) AS b, min(i) FILTER (i > anchor AND NOT ok) AS t FROM a GROUP BY event_type)
SELECT event_type, CASE WHEN found THEN coalesce(b + 1, f) ELSE 25 END AS low, CASE WHEN found THEN coalesce(t - 1, l) ELSE 25 END AS high FROM g""")
def contiguous_interval(spark, sf):
    m = X.log(spark, sf).groupBy("event_type", F.floor(F.col("value") / 10).alias("i")).agg(F.count("*").alias("n"))
    return ranking.contiguous_interval(m.select("event_type", "i", (F.col("n") % 3 != 0).alias("ok"), F.lit(25).cast("long").alias("anchor")), ("event_type",), "i", "ok", "anchor")


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_lengths(spark, sf):
    return ranking.top_k(X.log(spark, sf), ("event_type",), (F.desc("value"), "event_id"), 5).select("event_type", "event_id", "value", "rank")


_POOLS = f"{PXW_SQL}, a AS (SELECT scene, pix FROM pxw WHERE msk = 1 AND ref <> 255), b AS (SELECT scene, pix FROM pxw WHERE ref <> 255 AND pix % 100 < 90)"


def _pools(spark, sf):
    x = X.with_grid(X.pxw(spark, sf, "scene", "pix", "ref", "msk")).where("ref <> 255")
    n = X.lineitem(spark, sf).count()
    return tuple(ranking.deal(x.where(kept).select("scene", "pix"), n, "scene", "pix") for kept in ("msk = 1", "c < 90"))


@query(f"WITH {_POOLS}, f AS (SELECT coalesce(a.scene, b.scene) AS scene, a.pix AS pa, b.pix AS pb FROM a FULL JOIN b ON a.scene = b.scene AND a.pix = b.pix) SELECT scene, count(pa) AS n_a, count(pb) AS n_b, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS n_both, count(*) FILTER (pb IS NULL) AS only_a, count(*) FILTER (pa IS NULL) AS only_b, round(count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) / nullif(count(pa), 0), 9) AS coverage_a, round(count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) / nullif(count(pb), 0), 9) AS coverage_b, count(*) FILTER (pb IS NULL) = 0 AND count(*) FILTER (pa IS NULL) = 0 AS equal FROM f GROUP BY 1")
def pixel_pool_compare(spark, sf):
    a, b = _pools(spark, sf)
    return overlay.compare_pools(a, b, ["scene", "pix"]).withColumn("coverage_a", F.round("coverage_a", 9)).withColumn("coverage_b", F.round("coverage_b", 9))


@query(f"WITH {_POOLS}, d AS (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT scene, pix, side, nth FROM (SELECT *, row_number() OVER (PARTITION BY scene, side ORDER BY pix) AS nth FROM d) WHERE nth <= 3")
def first_mismatches(spark, sf):
    a, b = _pools(spark, sf)
    d = a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))
    return ranking.rank_rows(d, ("scene", "side"), ("pix",), "nth").where("nth <= 3")


@query(f"WITH {_POOLS} SELECT scene, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY scene")
def pool_intersection(spark, sf):
    a, b = _pools(spark, sf)
    return a.intersect(b).groupBy("scene").agg(F.count("*").alias("n"))


@query("SELECT user_id, value, NULL AS k FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, NULL, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'click'")
def union_by_name(spark, sf):
    e = X.log(spark, sf)
    return e.where("event_type = 'view'").select("user_id", "value").unionByName(e.where("event_type = 'click'").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id"), allowMissingColumns=True)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 1000003, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM lineitem)")
def sorted_subset(spark, sf):
    x = X.lineitem(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return sampling.sorted_subset(x, x.columns, 0.1, F.expr("(l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 1000003"), 1_000_003)


@query(f"WITH r AS ({_RUNS}) SELECT event_type, count(*) AS n, round(avg(iou), 9) AS iou_mean, round(median(iou), 9) AS iou_median, round(stddev_samp(iou), 9) AS iou_std, round(min(iou), 9) AS iou_min, round(max(iou), 9) AS iou_max, round(quantile_cont(iou, 0.025), 9) AS iou_ci_low, round(quantile_cont(iou, 0.975), 9) AS iou_ci_high FROM r GROUP BY event_type")
def median_ci_summary(spark, sf):
    return ranking.median_ci(_runs(spark, sf), ("event_type",), "iou")


_BS = "(((CAST(rep AS BIGINT) * 7919 + CAST(draw AS BIGINT) * 104729 + 42) * 48271) % 2147483647) * 16807 % 2147483647 % n"
_BOOT = f"""WITH {PXV_SQL}, code AS (SELECT scene, count(*) FILTER (y = 1 AND p_2 > 0.5) AS a, count(*) FILTER (y = 0 AND p_2 > 0.5) AS b, count(*) FILTER (y = 1 AND NOT p_2 > 0.5) AS c, count(*) AS n FROM pxv GROUP BY scene),
d AS (SELECT scene, a, b, c, n, rep, {_BS} AS x FROM code, (SELECT unnest(range(0, 50)) AS rep), (SELECT unnest(range(0, 100)) AS draw)),
s AS (SELECT scene, CAST(rep AS INT) AS rep, count(*) FILTER (x < a) AS tp, count(*) FILTER (x >= a AND x < a + b) AS fp, count(*) FILTER (x >= a + b AND x < a + b + c) AS fn, count(*) FILTER (x >= a + b + c) AS tn FROM d GROUP BY ALL)"""


def _boot(spark, sf):
    from gridmetric.functions.scalar import confusion_code, threshold_probability

    x = X.pxw_valid(spark, sf, "scene", "y", "p_2")
    return sampling.bootstrap(x.select("scene", confusion_code("y", threshold_probability("p_2", 0.5)).alias("code")), ["scene"], 50, 100)


@query(f"{_BOOT} SELECT * FROM s")
def bootstrap_hash(spark, sf):
    return _boot(spark, sf)


@query(f"{_BOOT}, m AS (SELECT scene, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s) SELECT scene, count(*) AS n_reps, round(avg(iou), 9) AS iou_mean, round(stddev_samp(iou), 9) AS iou_std, round(quantile_cont(iou, 0.025), 9) AS iou_ci_low, round(quantile_cont(iou, 0.975), 9) AS iou_ci_high, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_std, round(quantile_cont(f1, 0.025), 9) AS f1_ci_low, round(quantile_cont(f1, 0.975), 9) AS f1_ci_high FROM m GROUP BY scene")
def bootstrap_summary(spark, sf):
    from gridmetric.operators.metrics import binary_metrics

    m = binary_metrics()
    return sampling.bootstrap_summary(_boot(spark, sf).select("scene", m["iou"].alias("iou"), m["f1"].alias("f1")), ["scene"], ("iou", "f1"))
