"""Queries of tile grids, views, stitching, and lines."""

import json

import numpy as np
from pyspark.sql import functions as F

from gridmetric.operators import chaining, geometry, tiles
from gridmetric.plans.registry import query
from gridmetric.sources import fixtures as X
from gridmetric.sources.fixtures import CHIP_SQL

_SCENES = "(SELECT user_id AS scene, CAST(100 + user_id * 37 % 900 AS INT) AS height, CAST(80 + user_id * 53 % 700 AS INT) AS width FROM (SELECT DISTINCT user_id FROM events))"
_PIX = f"{CHIP_SQL}, pix AS (SELECT tile_id, scene, y0, x0, CAST(k // 8 AS INT) AS i, CAST(k % 8 AS INT) AS j, vals[k + 1] AS v FROM chip, (SELECT unnest(range(0, 64)) AS k))"


def scenes(spark, sf):
    u = X.log(spark, sf).select("user_id").distinct()
    return u.selectExpr("user_id AS scene", "CAST(100 + user_id * 37 % 900 AS INT) AS height", "CAST(80 + user_id * 53 % 700 AS INT) AS width")


def _axis_sql(shift: bool) -> str:
    if shift:
        return "list_sort(list_distinct(list_concat(range(0, greatest(height - 224, 0) + 1, 96), [greatest(height - 224, 0)])))"
    return "range(0, height, 96)"


@query(f"SELECT scene, CASE WHEN height <= 224 THEN '0' ELSE array_to_string({_axis_sql(True)}, ',') END AS starts FROM {_SCENES}")
def axis_starts_shift(spark, sf):
    return scenes(spark, sf).select("scene", F.array_join(tiles.axis_starts(F.col("height"), 224, 96).cast("array<string>"), ",").alias("starts"))


@query(f"SELECT scene, CASE WHEN height <= 224 THEN '0' ELSE array_to_string({_axis_sql(False)}, ',') END AS starts FROM {_SCENES}")
def axis_starts_sliver(spark, sf):
    return scenes(spark, sf).select("scene", F.array_join(tiles.axis_starts(F.col("height"), 224, 96, "allow_sliver").cast("array<string>"), ",").alias("starts"))


def _starts(n: str) -> str:
    return f"CASE WHEN {n} <= 224 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, {n} - 223, 96), [{n} - 224]))) END"


@query(f"""WITH g AS (SELECT scene, height, width, {_starts('height')} AS ys, {_starts('width')} AS xs FROM {_SCENES}), e AS (SELECT *, unnest(range(0, len(ys) * len(xs))) AS id FROM g)
SELECT scene, CAST(id AS INT) AS tile_id, CAST(ys[id // len(xs) + 1] AS INT) AS valid_y0, CAST(xs[id % len(xs) + 1] AS INT) AS valid_x0, CAST(least(224, height - ys[id // len(xs) + 1]) AS INT) AS valid_h, CAST(least(224, width - xs[id % len(xs) + 1]) AS INT) AS valid_w,
CAST(ys[id // len(xs) + 1] - 16 AS INT) AS origin_y, CAST(xs[id % len(xs) + 1] - 16 AS INT) AS origin_x FROM e""")
def tile_grid(spark, sf):
    return tiles.tile_grid(scenes(spark, sf), 224, 96, 16)


def pixels(spark, sf):
    return tiles.tile_pixels(X.chips(spark, sf), 8)


@query(f"WITH {_PIX} SELECT tile_id, i - 2 AS i, j - 2 AS j, v FROM pix WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5")
def interior_crop(spark, sf):
    return tiles.interior(pixels(spark, sf), 2, 4, 4).select("tile_id", "i", "j", "v")


@query(f"WITH {_PIX} SELECT 'hflip' AS view, tile_id, i, 7 - j AS j, v FROM pix UNION ALL SELECT 'vflip', tile_id, 7 - i, j, v FROM pix UNION ALL SELECT 'hvflip', tile_id, 7 - i, 7 - j, v FROM pix")
def flip_views(spark, sf):
    x = pixels(spark, sf).select("tile_id", "i", "j", "v")
    parts = [tiles.flip(x, v, 8, 8).withColumn("view", F.lit(v)) for v in ("hflip", "vflip", "hvflip")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_PIX} SELECT tile_id, i, j, round(avg(1 / (1 + exp(-(v + 0.1 * fj)))), 9) AS p FROM (SELECT tile_id, i, j, v, unnest([j, 7 - j, j, 7 - j]) AS fj FROM pix) GROUP BY ALL")
def tta_mean(spark, sf):
    from gridmetric.functions.scalar import sigmoid

    # A scorer that sees where a pixel is, so that the views differ.
    got = tiles.tta_mean(pixels(spark, sf), ["identity", "hflip", "vflip", "hvflip", "hflip"], 8, 8, lambda v, i, j: sigmoid(v + 0.1 * j))
    return got.withColumn("p", F.round("p", 9))


_W = "greatest(0.5 - 0.5 * cos(2 * pi() * k / 7), 0.05) / (SELECT max(greatest(0.5 - 0.5 * cos(2 * pi() * q / 7), 0.05)) FROM (SELECT unnest(range(0, 8)) AS q))"


@query(f"WITH {_PIX}, w AS (SELECT CAST(k AS INT) AS k, {_W} AS w FROM (SELECT unnest(range(0, 8)) AS k)) SELECT tile_id, i, j, round(a.w * b.w, 9) AS w FROM pix JOIN w a ON a.k = i JOIN w b ON b.k = j")
def blend_weights(spark, sf):
    """The weight of each pixel of each tile."""
    return pixels(spark, sf).select("tile_id", "i", "j", F.round(tiles.weight("i", "j", 8, 8), 9).alias("w"))


_STITCH = f"{_PIX}, w AS (SELECT CAST(k AS INT) AS k, {_W} AS w FROM (SELECT unnest(range(0, 8)) AS k)), st AS (SELECT y0 + i AS r, x0 + j AS c, sum(v * a.w * b.w) / sum(a.w * b.w) AS p FROM pix JOIN w a ON a.k = i JOIN w b ON b.k = j GROUP BY ALL)"


@query(f"WITH {_STITCH} SELECT r, c, round(p, 8) AS p FROM st")
def stitch_weighted(spark, sf):
    return tiles.stitch_weighted(pixels(spark, sf), 8).withColumn("p", F.round("p", 8))


@query(f"WITH {_PIX} SELECT r, c, p FROM (SELECT y0 + i AS r, x0 + j AS c, v AS p, row_number() OVER (PARTITION BY y0 + i, x0 + j ORDER BY tile_id DESC) AS n FROM pix) WHERE n = 1")
def stitch_crop_only(spark, sf):
    return tiles.stitch_crop_only(pixels(spark, sf))


@query(f"WITH {_PIX}, cov AS (SELECT DISTINCT y0 + i AS r, x0 + j AS c FROM pix WHERE tile_id % 7 <> 0) SELECT CAST(k // (SELECT max(x0) + 8 FROM chip) AS INT) AS r, CAST(k % (SELECT max(x0) + 8 FROM chip) AS INT) AS c FROM (SELECT unnest(range(0, (SELECT (max(y0) + 8) * (max(x0) + 8) FROM chip))) AS k) WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.r = k // (SELECT max(x0) + 8 FROM chip) AND cov.c = k % (SELECT max(x0) + 8 FROM chip))")
def coverage_gaps(spark, sf):
    # The canvas is that of all tiles; every seventh is left out, as in the SQL, so that there are gaps.
    st = tiles.stitch_weighted(pixels(spark, sf).where("tile_id % 7 <> 0"), 8)
    size = X.chips(spark, sf).agg((F.max("y0") + 8).alias("height"), (F.max("x0") + 8).alias("width")).first()
    return tiles.coverage_gaps(st, size.height or 0, size.width or 0)


@query(f"WITH {_STITCH}, cell AS (SELECT CAST(k // 30 AS INT) - 10 AS r, CAST(k % 30 AS INT) - 10 AS c FROM (SELECT unnest(range(0, 900)) AS k)) SELECT cell.r, cell.c, coalesce(round(p, 8), -99.0) AS p FROM cell LEFT JOIN st ON st.r = cell.r AND st.c = cell.c")
def boundless_fill(spark, sf):
    st = tiles.stitch_weighted(pixels(spark, sf), 8).withColumn("p", F.round("p", 8))
    cells = spark.range(900).selectExpr("CAST(id div 30 AS INT) - 10 AS r", "CAST(id % 30 AS INT) - 10 AS c")
    return tiles.boundless_read(st, cells, {"p": -99.0}, ("r", "c"))


_LINES = "WITH l AS (SELECT user_id AS contour_id, list(value ORDER BY ts, event_id) AS x, list(CAST(event_id % 100 AS DOUBLE) ORDER BY ts, event_id) AS y FROM events GROUP BY user_id)"


def _lines(spark, sf):
    v = F.struct("ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    g = X.log(spark, sf).groupBy(F.col("user_id").alias("contour_id")).agg(F.array_sort(F.collect_list(v)).alias("v"))
    return g.select("contour_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("vertices"))


@query(f"{_LINES}, s AS (SELECT contour_id, len(x) AS n_vertices, list_sum([sqrt((x[k + 1] - x[k]) * (x[k + 1] - x[k]) + (y[k + 1] - y[k]) * (y[k + 1] - y[k])) for k in range(1, len(x))]) AS length FROM l) SELECT contour_id, CAST(n_vertices AS INT) AS n_vertices, round(length, 6) AS length FROM s WHERE n_vertices >= 2 AND length > 0")
def line_lengths(spark, sf):
    return geometry.valid_lines(_lines(spark, sf)).select("contour_id", "n_vertices", F.round("length", 6).alias("length"))


@query(f"{_LINES}, s AS (SELECT contour_id, len(x) AS n_vertices, 1 + list_sum([greatest(1, CAST(ceil(sqrt((x[k + 1] - x[k]) * (x[k + 1] - x[k]) + (y[k + 1] - y[k]) * (y[k + 1] - y[k])) / 25) AS BIGINT)) for k in range(1, len(x))]) AS n FROM l) SELECT contour_id, CAST(n AS BIGINT) AS n_points FROM s WHERE n_vertices >= 2")
def densify_lines(spark, sf):
    x = _lines(spark, sf).where(F.size("vertices") >= 2)
    return x.select("contour_id", F.size(geometry.densify("vertices", 25.0)).cast("long").alias("n_points"))


@query()
def simplify_line(spark, sf):
    x = _lines(spark, sf).withColumn("vertices", geometry.simplify(20.0)("vertices"))
    return geometry.valid_lines(x).select("contour_id", "n_vertices", "length")


def _canvas(spark, sf):
    return tiles.stitch_weighted(pixels(spark, sf), 8).withColumn("scene", F.lit(0))


_SCENE_STITCH = f"{_PIX}, w AS (SELECT CAST(k AS INT) AS k, {_W} AS w FROM (SELECT unnest(range(0, 8)) AS k)), st AS (SELECT scene, y0 + i AS r, x0 + j AS c, sum(v * a.w * b.w) / sum(a.w * b.w) AS p FROM pix JOIN w a ON a.k = i JOIN w b ON b.k = j GROUP BY ALL)"


def _segments_sql(stitched: str = _STITCH, by: str = "") -> str:
    """Marching squares at level 0, a scene at a time with by = "scene, ": points on the top (T), left (L), bottom (B) and right side (S) of a cell, and the segments between them by case."""
    points = {"T": ("c + a / (a - b)", "r", "2 * r", "2 * c + 1"), "L": ("c", "r + a / (a - d)", "2 * r + 1", "2 * c"), "B": ("c + d / (d - e)", "r + 1", "2 * r + 2", "2 * c + 1"), "S": ("c + 1", "r + b / (b - e)", "2 * r + 1", "2 * c + 2")}
    cases = {1: ["LT"], 2: ["TS"], 3: ["LS"], 4: ["SB"], 6: ["TB"], 7: ["LB"], 8: ["BL"], 9: ["BT"], 11: ["BS"], 12: ["SL"], 13: ["ST"], 14: ["TL"]}
    saddles = {(5, True): ["LB", "ST"], (5, False): ["LT", "SB"], (10, True): ["TL", "BS"], (10, False): ["TS", "BL"]}
    edge = lambda p: f"(CAST({points[p][2]} AS BIGINT) * {1 << 32} + {points[p][3]})"
    segment = lambda s: f"{{'s': {edge(s[0])}, 'e': {edge(s[1])}, 'len': sqrt(pow({points[s[1]][0]} - ({points[s[0]][0]}), 2) + pow({points[s[1]][1]} - ({points[s[0]][1]}), 2))}}"
    when = [f"WHEN code = {k} THEN [{', '.join(map(segment, v))}]" for k, v in cases.items()]
    when += [f"WHEN code = {k} AND {'' if high else 'NOT '}high THEN [{', '.join(map(segment, v))}]" for (k, high), v in saddles.items()]
    return f"""{stitched}, rw AS (SELECT {by}r, c, p AS a, CASE WHEN lead(c) OVER o = c + 1 THEN lead(p) OVER o END AS b FROM st WINDOW o AS (PARTITION BY {by}r ORDER BY c)),
ce AS (SELECT {by}r, c, a, b, CASE WHEN lead(r) OVER o = r + 1 THEN lead(a) OVER o END AS d, CASE WHEN lead(r) OVER o = r + 1 THEN lead(b) OVER o END AS e FROM rw WINDOW o AS (PARTITION BY {by}c ORDER BY r)),
cd AS (SELECT *, (a > 0)::INT + 2 * (b > 0)::INT + 4 * (e > 0)::INT + 8 * (d > 0)::INT AS code, (a + b + d + e) / 4 > 0 AS high FROM ce WHERE b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL),
sg AS (SELECT {by}unnest(CASE {' '.join(when)} END, recursive := true) FROM cd WHERE code NOT IN (0, 15))"""


def _chains_sql(rounds: int = 18) -> str:
    """Each segment's contour by pointer jumping, for contours of fewer than 2 ** rounds segments: the first edge, or of a ring the least."""
    out = [f"{_segments_sql()}, j0 AS MATERIALIZED (SELECT a.s, coalesce(b.s, a.s) AS ptr, a.s AS m, b.s IS NULL AS done FROM sg a LEFT JOIN sg b ON b.e = a.s)"]
    out += [f"j{k + 1} AS MATERIALIZED (SELECT a.s, b.ptr, least(a.m, b.m) AS m, b.done FROM j{k} a JOIN j{k} b ON a.ptr = b.s)" for k in range(rounds)]
    return ", ".join(out) + f", chained AS (SELECT CASE WHEN done THEN ptr ELSE m END AS contour_id, sg.s, sg.e, len FROM j{rounds} j JOIN sg ON sg.s = j.s)"


@query(f"""WITH {_chains_sql()}, t AS (SELECT contour_id, count(*) + 1 AS n_vertices, round(sum(len), 6) AS length FROM chained GROUP BY contour_id HAVING sum(len) > 0)
SELECT 0 AS scene, contour_id, n_vertices, length, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY length DESC, contour_id) AS INT) AS rank FROM t) WHERE rank <= 20""")
def contours(spark, sf):
    """The 20 longest contours. Lengths are sums over parts, so no line is put together."""
    parts = chaining.contour_parts(geometry.iso_segments(_canvas(spark, sf), 0.0))
    lengths = chaining.contour_lengths(parts).withColumn("length", F.round("length", 6))
    return geometry.top_k_longest(lengths, ("scene",), 20).select("scene", "contour_id", "n_vertices", "length", "rank")


@query(f"""WITH {_chains_sql()} SELECT 0 AS scene, contour_id, count(*) AS n_segments, round(sum(len), 6) AS length, bool_or(e = contour_id) AS closed FROM chained GROUP BY contour_id""")
def contour_chains(spark, sf):
    """Every contour in blocks of 16 x 16 cells, so that most go over several, with its number of segments and whether it is a ring."""
    parts = chaining.contour_parts(geometry.iso_segments(_canvas(spark, sf), 0.0), block=16)
    sums = parts.groupBy("scene", "contour_id").agg(F.sum("n").alias("n_segments"), F.round(F.sum("length"), 6).alias("length"), F.max_by("e", "part").alias("last"))
    return sums.select("scene", "contour_id", "n_segments", "length", (F.col("last") == F.col("contour_id")).alias("closed"))


@query(f"WITH {_segments_sql()} SELECT 0 AS scene, count(*) AS n_segments, round(sum(len), 4) AS total_length FROM sg")
def iso_segment_stats(spark, sf):
    return geometry.contour_stats(geometry.iso_segments(_canvas(spark, sf), 0.0)).withColumn("total_length", F.round("total_length", 4))


@query(f"WITH {CHIP_SQL} SELECT CAST(scene AS VARCHAR) AS split, row_number() OVER (PARTITION BY scene ORDER BY tile_id) - 1 AS chip_id, 64 AS n, round(list_sum(list_transform(vals, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS vv_sum, CAST(len(list_filter(vals, lambda x: x > 0)) AS INT) AS water FROM chip")
def raw_tile_scan(spark, sf):
    """All chips written as flat binary, a folder a scene in the shared folder, and read back by record ranges.

    The bands are a chip's values and their negatives, the mask is where values are positive. A chip is known by its scene (split) and its place there.
    Ranges of scenes and tiles are dealt to tasks, so that a large scene is several files.
    """
    chips = _raw_chips(spark, sf, height=8, recordsPerPartition=64)
    total = F.aggregate("vv", F.lit(0.0), lambda s, x: s + x)
    return chips.select("split", "chip_id", F.size("vv").alias("n"), F.round(total, 4).alias("vv_sum"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("water"))


def _planes(chips):
    """Rows of the raw sink: values, their negatives, and where they are positive."""
    as_float = lambda f: F.transform("values", f).cast("array<float>")
    return chips.select(F.col("scene").cast("string").alias("split"), as_float(lambda x: x).alias("vv"), as_float(lambda x: -x).alias("vh"), F.transform("values", lambda x: (x > 0).cast("short")).alias("mask"))


def _written(spark, rows, **options):
    """The folder to which the rows were written as raw records."""
    from gridmetric.sources.raw_tiles import RawTileSource
    from gridmetric.sources.shared import qualified, scratch_folder

    spark.dataSource.register(RawTileSource)
    folder = qualified(spark, scratch_folder(spark, "rawtile"))
    rows.write.format("rawtile").options(width=8, **options).mode("append").save(folder)
    return folder


def _raw_chips(spark, sf, splits=None, **options):
    dealt = X.chips(spark, sf).select("scene", "tile_id", "values").repartitionByRange("scene", "tile_id").sortWithinPartitions("scene", "tile_id")
    folder = _written(spark, _planes(dealt), height=8)
    more = {} if splits is None else {"splits": json.dumps(splits)}
    return spark.read.format("rawtile").options(width=8, **more, **options).load(folder)


@query(f"WITH {CHIP_SQL} SELECT CAST(scene AS VARCHAR) AS split, row_number() OVER (PARTITION BY scene ORDER BY tile_id) - 1 AS chip_id, 192 AS n, round(CAST(len(list_filter(vals, lambda x: x > 0)) AS DOUBLE), 3) AS total FROM chip")
def raw_raster_scan(spark, sf):
    """The same files as rasters of one band of 24 x 8: values, their negatives and ones where they are positive add up to the number of these."""
    bands = _raw_chips(spark, sf, planes=1, height=24)
    return bands.select("split", "chip_id", F.size("band").alias("n"), F.round(F.abs(F.aggregate("band", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


@query(f"WITH {CHIP_SQL}, w AS (SELECT CAST(scene AS VARCHAR) AS split FROM chip UNION ALL SELECT 'val' WHERE FALSE) SELECT split, count(*) AS n FROM w GROUP BY split")
def split_counts(spark, sf):
    """Chips of each split; a split without a file has none."""
    labels = [str(r.scene) for r in X.chips(spark, sf).select("scene").distinct().collect()]  # names of splits, a short list
    return _raw_chips(spark, sf, [*labels, "val", "test"], height=8).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH {CHIP_SQL}, h AS (SELECT *, (tile_id * 7919 + 42) % 1000003 AS h FROM chip), s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, tile_id) AS nth, count(*) OVER () AS n FROM h) WHERE nth <= CAST(floor(n * 0.1) AS BIGINT))
SELECT row_number() OVER (ORDER BY tile_id) - 1 AS chip_id, round(list_sum(list_transform(vals, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 4) AS vv_sum, CAST(len(list_filter(vals, lambda x: x > 0)) AS INT) AS water FROM s""")
def raw_subset(spark, sf):
    """A tenth of all chips, without replacement, written in their order to raw files and read back."""
    from gridmetric.operators.sampling import sorted_subset as subset

    some = subset(X.chips(spark, sf), ["tile_id"], 0.1, F.expr("(tile_id * 7919 + 42) % 1000003"), 1_000_003)
    rows = _planes(some.repartitionByRange("tile_id").sortWithinPartitions("tile_id")).drop("split")
    chips = spark.read.format("rawtile").options(width=8, height=8, recordsPerPartition=16).load(_written(spark, rows, height=8))
    return chips.select("chip_id", F.round(F.aggregate("vv", F.lit(0.0), lambda s, x: s + x), 4).alias("vv_sum"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("water"))


@query(f"WITH {CHIP_SQL} SELECT tile_id, CAST(row_number() OVER (ORDER BY ((tile_id * 7919 + 42) % 2147483647 * 48271) % 2147483647, tile_id) AS INT) AS place FROM chip")
def seeded_shuffle(spark, sf):
    from gridmetric.operators.sampling import seeded_shuffle as shuffle

    return shuffle(X.chips(spark, sf).select("tile_id"), "tile_id", 42)


@query(f"WITH {_segments_sql(_SCENE_STITCH, 'scene, ')} SELECT scene, CASE WHEN scene % 3 = 0 THEN 'skip' ELSE 'extract' END AS action, count(s) AS n_segments, round(coalesce(sum(len), 0), 4) AS total_length FROM (SELECT DISTINCT scene FROM chip) LEFT JOIN sg USING (scene) GROUP BY scene")
def contour_batches(spark, sf):
    """Contours of each scene's own canvas, extracted in batches. Every third scene was extracted before, and is skipped by the run over all."""
    from gridmetric.sources.shared import scratch_folder

    chips = X.chips(spark, sf)
    canvas = tiles.stitch_weighted(tiles.tile_pixels(chips, 8), 8, keys=("scene",))
    root = scratch_folder(spark, "contours")
    chaining.extract_contours(canvas.where("scene % 3 = 0"), root, 0.0)
    status = chaining.extract_contours(canvas, root, 0.0)
    lines = spark.read.parquet(f"{root}/lines").groupBy("scene").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return status.join(lines, "scene", "left").select("scene", "action", zero(F.col("n")).alias("n_segments"), F.round(zero(F.col("length")), 4).alias("total_length"))


@query(f"WITH {CHIP_SQL} SELECT tile_id, round(list_sum(list_transform(vals, lambda m: 1 / (1 + exp(-m)))), 6) AS total FROM chip")
def score_tiles(spark, sf):
    return tiles.score_tiles(X.chips(spark, sf), lambda m: 1 / (1 + np.exp(-m))).select("tile_id", F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _draw_sql(k: int) -> str:
    m, a = tiles.MODULUS, tiles.DRAWS[k]
    once = f"((((tile_id % {m}) * 7919 + {(42 + k) * 104_729}) % {m}) * {a}) % {m}"
    return f"((xor({once}, ({once}) >> 13) * {a}) % {m})"


@query(f"""WITH {CHIP_SQL}, d AS (SELECT *, {_draw_sql(0)} < {int(0.5 * tiles.MODULUS)} AS hflip, {_draw_sql(1)} < {int(0.5 * tiles.MODULUS)} AS vflip, CAST(CASE WHEN {_draw_sql(2)} < {int(0.5 * tiles.MODULUS)} THEN {_draw_sql(3)} % 3 + 1 ELSE 0 END AS INT) AS turns FROM chip),
s AS (SELECT *, CASE turns WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 3 THEN 7 ELSE 0 END AS si, CASE turns WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE 0 END AS sj FROM d)
SELECT tile_id, hflip, vflip, turns, round(vals[(CASE WHEN vflip THEN 7 - si ELSE si END) * 8 + (CASE WHEN hflip THEN 7 - sj ELSE sj END) + 1], 6) AS corner FROM s""")
def augmented_tiles(spark, sf):
    x = tiles.random_augment(X.chips(spark, sf), ["values"], 8)
    return x.select("tile_id", "hflip", "vflip", "turns", F.round(F.get("values", F.lit(0)), 6).alias("corner"))
