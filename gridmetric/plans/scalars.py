"""Queries of scalar functions, predicates and identifiers."""

from pyspark.sql import functions as F

from gridmetric.functions import scalar as S
from gridmetric.operators import metrics, ranking
from gridmetric.plans.registry import query
from gridmetric.sources import fixtures as X
from gridmetric.sources.fixtures import PXV_SQL, PXW_SQL


@query(f"WITH {PXW_SQL} SELECT scene, pix, CASE WHEN p_0 > 0.5 THEN 1 ELSE 0 END AS pred FROM pxw")
def threshold_gt(spark, sf):
    return X.pxw(spark, sf, "scene", "pix", "p_0").select("scene", "pix", S.threshold_probability("p_0", 0.5).alias("pred"))


@query(f"WITH {PXW_SQL} SELECT scene, pix, CASE WHEN p_0 >= 0.5 THEN 1 ELSE 0 END AS pred FROM pxw")
def threshold_ge(spark, sf):
    return X.pxw(spark, sf, "scene", "pix", "p_0").select("scene", "pix", S.threshold_probability("p_0", 0.5, "greater_equal").alias("pred"))


@query(f"WITH {PXW_SQL} SELECT scene, pix, CASE WHEN ref IN (1) THEN 1 ELSE 0 END AS y FROM pxw WHERE ref NOT IN (255) AND msk = 1")
def binarize_valid_mask(spark, sf):
    return X.valid(X.pxw(spark, sf, "scene", "pix", "ref", "msk")).select("scene", "pix", S.binarise("ref").alias("y"))


@query(f"WITH {PXW_SQL} SELECT scene, pix, round((vv + 15.0) / 6.5, 9) AS vv_std, round((vh + 22.0) / 5.5, 9) AS vh_std FROM pxw")
def standardize_db(spark, sf):
    return X.pxw(spark, sf, "scene", "pix", "vv", "vh").select("scene", "pix", F.round(S.standardise("vv", -15.0, 6.5), 9).alias("vv_std"), F.round(S.standardise("vh", -22.0, 5.5), 9).alias("vh_std"))


@query("SELECT vec_id AS tile_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 9) AS p FROM embeddings")
def sigmoid_prob(spark, sf):
    return X.chips(spark, sf).select("tile_id", F.round(S.water_probability([F.get("values", F.lit(0))]), 9).alias("p"))


@query("WITH x AS (SELECT vec_id AS tile_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT tile_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 9) AS p FROM x")
def softmax_water(spark, sf):
    return X.chips(spark, sf).select("tile_id", F.round(S.water_probability([F.get("values", F.lit(0)), F.get("values", F.lit(1))]), 9).alias("p"))


@query("SELECT vec_id AS tile_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class FROM embeddings")
def argmax_class(spark, sf):
    return X.chips(spark, sf).select("tile_id", S.argmax_class("values").cast("long").alias("class"))


_CODE = "CASE WHEN NOT (ref <> 255 AND msk = 1) THEN 0 WHEN y = 1 AND p_3 > 0.5 THEN 1 WHEN p_3 > 0.5 THEN 2 WHEN y = 1 THEN 3 ELSE 4 END"


def _coded(spark, sf):
    ok = (F.col("ref") != 255) & (F.col("msk") == 1)
    x = X.pxw(spark, sf, "scene", "pix", "ref", "msk", "y", "p_3").withColumn("ok", ok)
    return x.select("scene", "pix", S.confusion_code("y", S.threshold_probability("p_3", 0.5), "ok").alias("cm"))


@query(f"WITH {PXW_SQL} SELECT scene, pix, {_CODE} AS cm FROM pxw")
def confusion_encode(spark, sf):
    return _coded(spark, sf)


@query(f"WITH {PXW_SQL}, c AS (SELECT scene, {_CODE} AS cm FROM pxw) SELECT scene, count(*) FILTER (cm IN (1, 2)) AS predicted, count(*) FILTER (cm IN (1, 3)) AS reference, count(*) FILTER (cm IN (2, 3)) AS error FROM c GROUP BY scene")
def confusion_decode(spark, sf):
    d = S.decode_confusion("cm")
    return _coded(spark, sf).groupBy("scene").agg(*(F.sum(c).alias(n) for n, c in d.items()))


@query(f"WITH {PXW_SQL} SELECT scene, least(CAST(floor(greatest(0.0, least(1.0, p_1)) * 50) AS BIGINT), 49) AS bin, count(*) AS n FROM pxw GROUP BY ALL")
def clip_finebin(spark, sf):
    return X.pxw(spark, sf, "scene", "p_1").groupBy("scene", S.fine_bin("p_1", 50).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_EDGES = S.linspace(0.0, 1.0, 11)


@query(f"WITH {PXW_SQL}, b AS (SELECT scene, CASE WHEN p_1 = 1.0 THEN 9 ELSE len(list_filter({_EDGES}, lambda e: p_1 >= e)) - 1 END AS bin FROM pxw WHERE p_1 BETWEEN 0 AND 1) SELECT scene, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY ALL")
def hist_edge_bin(spark, sf):
    from gridmetric.operators.auc import histogram

    return histogram(X.pxw(spark, sf, "scene", "p_1"), ["scene"], "p_1", _EDGES).withColumn("bin", F.col("bin").cast("long"))


@query("SELECT event_id, l AS lat, round(abs(111412.84 * cos(radians(l)) - 93.5 * cos(3 * radians(l))), 6) AS m_lon, round(abs(111132.92 - 559.82 * cos(2 * radians(l)) + 1.175 * cos(4 * radians(l))), 6) AS m_lat FROM (SELECT event_id, CAST(event_id * 37 % 16000 - 8000 AS DOUBLE) / 100 AS l FROM events)")
def meters_per_degree(spark, sf):
    """Metres of a degree at a latitude of each event."""
    lon, lat = S.meters_per_degree("lat")
    return X.log(spark, sf).select("event_id", ((F.col("event_id") * 37 % 16000 - 8000).cast("double") / 100).alias("lat")).select("event_id", "lat", F.round(lon, 6).alias("m_lon"), F.round(lat, 6).alias("m_lat"))


@query(f"WITH {PXW_SQL} SELECT scene, pix, round(10.0 * (pix % 100 + 0.5) + 110.0, 6) AS x, round(-10.0 * (pix // 100 + 0.5) - 6.5, 6) AS y FROM pxw")
def affine_xy(spark, sf):
    grid = X.with_grid(X.pxw(spark, sf, "scene", "pix"))
    x, y = S.pixel_to_map("r", "c", *map(F.lit, (10.0, 0.0, 110.0, 0.0, -10.0, -6.5)))
    return grid.select("scene", "pix", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {PXV_SQL}, t AS (SELECT i AS t_idx, round(i * 0.01, 10) AS threshold FROM (SELECT CAST(unnest(range(0, 101)) AS INT) AS i)) SELECT t_idx, threshold, count(*) FILTER (p_1 > threshold) AS n_above FROM t, pxv GROUP BY ALL")
def threshold_grid(spark, sf):
    """The grid of thresholds, and how many of a member's scores lie above each: of scores that pass k thresholds, above the first k."""
    from gridmetric.operators.sweep import passed

    grid = S.threshold_grid(0.0, 1.0, 0.01)
    known = spark.createDataFrame(list(enumerate(grid)), "t_idx int, threshold double")
    counts = X.pxw_valid(spark, sf, "p_1").groupBy(passed("p_1", grid).alias("k")).agg(F.count("*").alias("n"))  # a row a threshold at most
    above = F.coalesce(F.sum(F.when(F.col("k") > F.col("t_idx"), F.col("n"))), F.lit(0)).alias("n_above")
    return known.crossJoin(F.broadcast(counts)).groupBy("t_idx", F.round("threshold", 10).alias("threshold")).agg(above)


@query(f"WITH {PXW_SQL} SELECT scene, count(*) AS n, count(*) FILTER (isfinite(vv) AND isfinite(vh)) AS n_finite FROM pxw GROUP BY scene")
def finite_bands(spark, sf):
    return X.pxw(spark, sf, "scene", "vv", "vh").groupBy("scene").agg(F.count("*").alias("n"), F.count_if(S.finite("vv", "vh")).alias("n_finite"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS score FROM events")
def finite_guard(spark, sf):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return X.log(spark, sf).select("event_id", S.finite_or_zero(broken).alias("score"))


@query("SELECT event_id, value / 500 AS t FROM events WHERE value / 500 BETWEEN 0 AND 1 AND props LIKE '%\"k\"%' AND event_type IN ('view', 'click')")
def range_and_text_filter(spark, sf):
    x = X.log(spark, sf).where(F.col("props").contains('"k"') & F.col("event_type").isin("view", "click"))
    return x.select("event_id", (F.col("value") / 500).alias("t")).where(F.col("t").between(0, 1))


@query(f"WITH {PXW_SQL}, q AS (SELECT scene, quantile_cont(vv, 0.02) AS lo, quantile_cont(vv, 0.98) AS hi FROM pxw GROUP BY scene) SELECT p.scene, pix, round(greatest(0.0, least(1.0, (vv - lo) / (hi - lo))), 9) AS stretched FROM pxw p JOIN q ON p.scene = q.scene")
def percentile_stretch(spark, sf):
    x = X.pxw(spark, sf, "scene", "pix", "vv")
    q = metrics.percentiles(x, ["scene"], "vv", {"lo": 0.02, "hi": 0.98})
    return x.join(q, "scene").select("scene", "pix", F.round(S.percentile_stretch("vv", "lo", "hi"), 9).alias("stretched"))


@query(f"WITH {PXW_SQL} SELECT scene, CASE ref WHEN 255 THEN 2 ELSE ref END AS label, count(*) AS n FROM pxw GROUP BY ALL")
def mask_remap(spark, sf):
    return X.pxw(spark, sf, "scene", "ref").groupBy("scene", F.when(F.col("ref") == 255, 2).otherwise(F.col("ref")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {PXV_SQL} SELECT scene, pix, CAST(p_0 AS FLOAT) AS p32, CAST(CAST(p_0 AS FLOAT) > CAST(0.1 AS FLOAT) AS INT) AS pred FROM pxv")
def float_threshold(spark, sf):
    x = X.pxw_valid(spark, sf, "scene", "pix", "p_0").withColumn("p32", F.col("p_0").cast("float"))
    return x.select("scene", "pix", "p32", S.threshold_probability("p32", 0.1, as_float=True).alias("pred"))


_IDS_SQL = "concat('S1_', strftime(l_shipdate, '%Y%m%d'), '_', lpad(CAST(l_linenumber AS VARCHAR), 6, '0'), '_', CAST(l_suppkey % 100 AS VARCHAR), '_8_9')"


def _ids(spark, sf):
    s1 = F.concat(F.lit("S1_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("l_linenumber").cast("string"), 6, "0"), F.lit("_"), (F.col("l_suppkey") % 100).cast("string"), F.lit("_8_9"))
    return X.lineitem(spark, sf).select("l_orderkey", "l_linenumber", s1.alias("s1"))


@query(f"WITH n AS (SELECT l_orderkey, l_linenumber, concat('ref_', CASE WHEN l_orderkey % 3 = 0 THEN 'none' ELSE {_IDS_SQL} END, '.tif') AS name FROM lineitem) SELECT l_orderkey, l_linenumber, nullif(regexp_extract(name, '{S.S1_ID}', 1), '') AS s1_id, regexp_extract(name, '{S.S2_ID}', 1) AS s2_id FROM n")
def extract_ids(spark, sf):
    name = F.concat(F.lit("ref_"), F.when(F.col("l_orderkey") % 3 == 0, "none").otherwise(F.col("s1")), F.lit(".tif"))
    return _ids(spark, sf).withColumn("name", name).select("l_orderkey", "l_linenumber", S.extract_id("name", S.S1_ID).alias("s1_id"), F.coalesce(S.extract_id("name", S.S2_ID), F.lit("")).alias("s2_id"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(trim(url), '.', 'p'), '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown') AS safe FROM pages")
def sanitize_path(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", S.sanitize_for_path("url").alias("safe"))


_MODES_SQL = "concat(c_name, CASE c_custkey % 4 WHEN 0 THEN '_Large_Crop_Only' WHEN 1 THEN '_native224' WHEN 2 THEN '_whole' ELSE '' END)"


@query(f"WITH n AS (SELECT c_custkey, lower({_MODES_SQL}) AS n FROM customer) SELECT c_custkey, CASE WHEN n LIKE '%large_crop_only%' THEN 'large_crop_only' WHEN n LIKE '%native224%' THEN 'native224' WHEN n LIKE '%whole%' THEN 'whole' ELSE '' END AS mode FROM n")
def infer_mode(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, ("_Large_Crop_Only", "_native224", "_whole", ""))), (F.col("c_custkey") % 4).cast("int") + 1)
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", S.infer_inference_mode(F.concat("c_name", tail)).alias("mode"))


@query(f"SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS d, {_IDS_SQL} AS s1 FROM lineitem")
def scene_date(spark, sf):
    return _ids(spark, sf).select("l_orderkey", "l_linenumber", S.scene_date("s1").alias("d"), "s1")


@query("SELECT event_id, concat('run-', user_id) AS name FROM events")
def strip_run_timestamp(spark, sf):
    name = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("__"), S.timestamp_id("ts"))
    return X.log(spark, sf).select("event_id", S.strip_run_timestamp(name).alias("name"))


@query("SELECT event_id, concat('runs/', event_type, '/', user_id, '/', user_id, '_probability_water.tif') AS path FROM events")
def path_template(spark, sf):
    return X.log(spark, sf).select("event_id", S.fill_template("{run_dir}/{s1_id}/{s1_id}_probability_water.tif", run_dir=F.concat(F.lit("runs/"), "event_type"), s1_id=F.col("user_id").cast("string")).alias("path"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.0fk', n / 1000) ELSE CAST(n AS VARCHAR) END AS txt FROM (SELECT o_orderkey, (o_orderkey % 1000) * (o_orderkey % 1000) * 4 + 1 AS n FROM orders)")
def fmt_count(spark, sf):
    k = F.col("o_orderkey") % 1000
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", S.format_count(k * k * 4 + 1).alias("txt"))


@query("SELECT c_custkey, c_name AS base, 'tta' AS tiling FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name AS base, 'plain' AS tiling FROM customer WHERE c_custkey % 2 = 1")
def suffix_strip(spark, sf):
    n = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "_tta_flip4").otherwise("_none"))
    return spark.read.parquet(f"{sf}/customer.parquet").withColumn("n", n).select("c_custkey", S.strip_suffix("n", ["_tta_flip4", "_none"]).alias("base"), S.first_suffix("n", {"_tta_flip4": "tta", "_none": "plain"}).alias("tiling"))


@query("SELECT event_id, printf('%+.3f', value - 250) AS signed, printf('[%.4f, %.4f]', value / 500, value / 250) AS span, replace(event_type, 'c', 'C') AS renamed, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS code FROM events")
def format_fields(spark, sf):
    code = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("event_id") % 5).cast("string"))
    x = X.log(spark, sf).withColumn("raw", code)
    return x.select("event_id", S.format_signed(F.col("value") - 250).alias("signed"), S.format_interval(F.col("value") / 500, F.col("value") / 250).alias("span"), F.replace("event_type", F.lit("c"), F.lit("C")).alias("renamed"), S.return_code("raw").cast("long").alias("code"))


@query("SELECT user_id, event_type, CASE WHEN user_id % 3 = 0 THEN concat('unet-', replace(event_type, ' ', '_'), '_best_model') ELSE concat('epoch_', user_id) END AS id FROM (SELECT DISTINCT user_id, event_type FROM events)")
def checkpoint_ids(spark, sf):
    x = X.log(spark, sf).select("user_id", "event_type").distinct()
    stem = F.when(F.col("user_id") % 3 == 0, "best_model").otherwise(F.concat(F.lit("epoch "), F.col("user_id").cast("string")))
    return x.select("user_id", "event_type", S.checkpoint_id(stem, F.lit("unet"), "event_type").alias("id"))


@query("SELECT user_id, CASE user_id % 3 WHEN 0 THEN concat('team/proj/r', user_id) WHEN 1 THEN concat('proj/r', user_id) ELSE concat('mine/r', user_id) END AS run FROM (SELECT DISTINCT user_id FROM events)")
def run_references(spark, sf):
    u = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    ref = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("https://host/team/proj/runs/"), u, F.lit("?nw=1"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("proj/"), u)).otherwise(u)
    return X.log(spark, sf).select("user_id").distinct().select("user_id", S.run_reference(ref, "mine").alias("run"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS members, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def member_lists(spark, sf):
    g = X.log(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("m"))
    return g.select("user_id", F.array_join("m", ",").alias("members")).select("user_id", "members", F.size(F.split("members", ",")).cast("long").alias("n"))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS js, 'true' AS flag, concat('[', user_id, ',', event_id, ']') AS arr FROM events")
def json_and_cli(spark, sf):
    x = X.log(spark, sf).withColumn("m", F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("int"), F.lit("_step"), F.lit(1)))
    return x.select("event_id", F.to_json(S.drop_private("m")).alias("js"), S.cli_value(F.lit(True), "bool").alias("flag"), S.cli_value(F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string")), "array").alias("arr"))


@query("SELECT DISTINCT event_type, 'probability_map' AS kind FROM events")
def prediction_types(spark, sf):
    kind = F.when(F.col("event_type") == "view", "prob_map").when(F.col("event_type") == "click", None).otherwise("Probability")
    return X.log(spark, sf).select("event_type", S.prediction_type(kind).alias("kind")).distinct()


@query("""WITH c AS (SELECT DISTINCT user_id AS checkpoint, user_id % 3 = 0 AS limited, CASE WHEN user_id % 2 = 0 THEN 600 END AS max_size FROM events),
p AS (SELECT * FROM (VALUES ('base', 224, CAST(NULL AS INT)), ('large', 512, 64), ('whole', NULL, NULL)) v(preset, tile_size, buffer_size))
SELECT checkpoint, preset, tile_size + 2 * coalesce(buffer_size, 0) AS input_size, NOT (limited AND preset <> 'base') AND NOT coalesce(tile_size + 2 * coalesce(buffer_size, 0) > max_size, FALSE) AS compatible,
CASE WHEN limited AND preset <> 'base' THEN 'not_in_allowed_presets' WHEN tile_size + 2 * coalesce(buffer_size, 0) > max_size THEN 'input_too_large' ELSE '' END AS reason FROM c CROSS JOIN p""")
def preset_compatibility(spark, sf):
    c = X.log(spark, sf).select(F.col("user_id").alias("checkpoint")).distinct()
    c = c.select("checkpoint", F.when(F.col("checkpoint") % 3 == 0, F.array(F.lit("base"))).alias("allowed"), F.when(F.col("checkpoint") % 2 == 0, 600).alias("max_size"))
    p = spark.createDataFrame([("base", 224, None), ("large", 512, 64), ("whole", None, None)], "preset string, tile_size int, buffer_size int")
    return ranking.preset_compatibility(c, p).select("checkpoint", "preset", "input_size", "compatible", "reason")
