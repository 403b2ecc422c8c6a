"""Golden values, brute force on small arrays, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmetric.functions import scalar as S
from gridmetric.functions import student
from gridmetric.operators import auc, calibration, chaining, ensemble, geometry, metrics, overlay, ranking, sampling, sweep, threshold, tiles
from gridmetric.schemas import require_columns
from gridmetric.sources import files
from gridmetric.sources import fixtures as X


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stitch_constant_weights(spark):
    rows = [(0, 0, 0, i, j, 0.25) for i in range(4) for j in range(4)] + [(1, 0, 2, i, j, 0.75) for i in range(4) for j in range(4)]
    px = frame(spark, rows, "tile_id int, y0 int, x0 int, i int, j int, v double")
    got = tiles.stitch_weighted(px, 4, "constant").toPandas().pivot(index="r", columns="c", values="p").to_numpy()
    assert np.allclose(got, [[0.25, 0.25, 0.5, 0.5, 0.75, 0.75]] * 4)
    with pytest.raises(ValueError, match="missing coverage: 8"):
        tiles.require_coverage(tiles.stitch_weighted(px.where("tile_id = 0"), 4, "constant"), 4, 6)


@pytest.mark.parametrize("window", ["constant", "hann", "linear"])
def test_stitch_of_a_constant_is_constant(spark, window):
    rows = [(t, t * 2, t, i, j, 3.5) for t in range(3) for i in range(4) for j in range(4)]
    got = tiles.stitch_weighted(frame(spark, rows, "tile_id int, y0 int, x0 int, i int, j int, v double"), 4, window).toPandas()
    assert np.allclose(got.p, 3.5)


def test_views(spark):
    assert tiles.check_views(["identity", "hflip", "hflip"]) == ["identity", "hflip"]
    for names in ([], ["identity", "rot90"]):
        with pytest.raises(ValueError):
            tiles.check_views(names)
    px = frame(spark, [(0, i, j, float(4 * i + j)) for i in range(3) for j in range(4)], "tile_id int, i int, j int, v double")
    for view in tiles.VIEWS:
        twice = tiles.flip(tiles.flip(px, view, 3, 4), view, 3, 4)
        assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, px.collect()))
    one = tiles.tta_mean(px, list(tiles.VIEWS), 3, 4).toPandas().sort_values(["i", "j"])
    assert np.allclose(one.p, 1 / (1 + np.exp(-np.arange(12))))


def test_flip_array_matches_flip(spark):
    x = frame(spark, [(0, [float(k) for k in range(12)])], "tile_id int, values array<double>")
    for view, want in (("hflip", np.arange(12).reshape(3, 4)[:, ::-1]), ("vflip", np.arange(12).reshape(3, 4)[::-1])):
        assert np.array_equal(x.select(tiles.flip_array("values", view, 3, 4)).first()[0], want.ravel())


def test_axis_starts(spark):
    x = frame(spark, [(2176,), (1000,), (1024,)], "n int")
    got = [r[0] for r in x.select(tiles.axis_starts(F.col("n"), 1024, 1024)).collect()]
    assert got == [[0, 1024, 1152], [0], [0]]
    with pytest.raises(ValueError):
        tiles.tile_grid(x, 10, 20)
    with pytest.raises(ValueError):
        tiles.weights_1d(8, "hann", 0.0)


def test_augmentation_rate_and_repeatability(spark):
    x = spark.range(4000).select(F.col("id").alias("tile_id"), F.array(*[F.lit(float(k)) for k in range(4)]).alias("values"))
    got = tiles.random_augment(x, ["values"], 2).toPandas()
    assert abs((got.turns > 0).mean() - 0.5) < 0.04
    assert all(sorted(v) == [0, 1, 2, 3] for v in got["values"][:50])
    assert got.equals(tiles.random_augment(x, ["values"], 2).toPandas())


def test_zero_rules(spark):
    c = frame(spark, [(4, 0, 0, 0), (0, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    a, b = metrics.with_columns(c, metrics.binary_metrics()).collect()
    assert (a.oa, a.f1, a.precision, a.recall, a.iou, a.mcc) == (1, 0, 0, 0, 0, 0) and b.oa is None
    assert metrics.with_columns(c, metrics.ensemble_metrics()).first().iou is None
    big = frame(spark, [(3_000_000,) * 4], "tn long, fp long, fn long, tp long")
    assert metrics.with_columns(big, metrics.binary_metrics()).first().mcc == 0


def test_even_tie_is_water(spark):
    p = frame(spark, [("s", 1, 1, 5), ("s", 0, 2, 3)], "scene string, y int, pred_mask long, n long")
    v = ensemble.vote(p, 3, 2).first()
    assert (v.tp, v.fp, v.fn) == (5, 3, 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1000)), min_size=1, max_size=60), st.sampled_from(["greater_than", "greater_equal"]))
def test_sweep_equals_naive(spark, rows, comparison):
    px = frame(spark, [("m", 1, y, p / 1000) for y, p in rows], "model_name string, scene int, y int, p double")
    t = S.threshold_grid(0.0, 1.0, 0.1)
    a, b = (f(px, ["model_name", "scene"], t, comparison).select("t_idx", "tn", "fp", "fn", "tp").orderBy("t_idx").collect() for f in (sweep.threshold_sweep, sweep.naive_sweep))
    assert a == b
    assert all(r.tn + r.fp + r.fn + r.tp == len(rows) for r in a)
    assert all(x.tp >= y.tp and x.fp >= y.fp for x, y in zip(a, a[1:]))


def test_sweep_ignores_nan_and_uneven_thresholds(spark):
    px = frame(spark, [("m", 1, 1, float("nan")), ("m", 1, 1, 0.9), ("m", 1, 0, 0.35)], "model_name string, scene int, y int, p double")
    for t in ([0.3, 0.4, 0.95], S.threshold_grid(0, 1, 0.05)):
        a, b = (f(px, ["model_name", "scene"], t).select("t_idx", "tp", "fp").orderBy("t_idx").collect() for f in (sweep.threshold_sweep, sweep.naive_sweep))
        assert a == b


def test_threshold_grid():
    assert len(S.threshold_grid(0, 1, 0.01)) == 101
    for bad in ((0, 1, 0), (1, 0, 0.1)):
        with pytest.raises(ValueError):
            S.threshold_grid(*bad)


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 20, 200) / 20
    px = frame(spark, [("m", int(a), float(b)) for a, b in zip(y, p)] + [("one", 0, 0.5)], "model_name string, y int, p double")
    got = {r.model_name: r for r in auc.auc_summary(px, ["model_name"]).collect()}
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(got["m"].roc_auc - want) < 1e-8
    assert got["one"].roc_auc is None and got["one"].auc_status == "undefined_single_class_reference"


def test_score_curves_against_numpy(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(200), [0.0, 1.0, 0.3, 0.29]])
    y = rng.integers(0, 2, len(p))
    px = frame(spark, [(1, int(a), float(b)) for a, b in zip(y, p)], "scene int, y int, p double")
    got = auc.score_curves(px, ["scene"], 10).orderBy("bin").toPandas()
    edges = np.array(S.linspace(0.0, 1.0, 11))
    want = np.histogram(p[y == 1], edges)[0][::-1].cumsum()[::-1]
    assert got.tp.tolist() == want.tolist()


def test_ece_below_mce_and_merge(spark):
    rng = np.random.default_rng(5)
    px = frame(spark, [("m", int(a), float(b)) for a, b in zip(rng.integers(0, 2, 300), rng.random(300))], "model_name string, y int, p double")
    fine = calibration.fine_histogram(px, ["model_name"], 100)
    halves = [calibration.fine_histogram(px.where(f"(p * 1000) % 2 {c} 1"), ["model_name"], 100) for c in ("<", ">=")]
    a, b = (x.orderBy("bin").toPandas() for x in (fine, calibration.merge(*halves, ["model_name"])))
    assert (a.n == b.n).all() and np.allclose(a.sum_p, b.sum_p)
    e = calibration.ece_mce(calibration.coarse_table(fine, ["model_name"], calibration.fixed_edges(10), 100), ["model_name"]).first()
    assert 0 <= e.ece <= e.mce


def test_votes_equal_pixel_votes(spark, data):
    wide = X.pxw_valid(spark, data, "scene", "y", "p_0", "p_3", "p_6")
    p = ensemble.pattern_table(wide, ["p_0", "p_3", "p_6"])
    got = ensemble.vote(p, 7, 3).first()
    f = wide.toPandas()
    says = (f[["p_0", "p_3", "p_6"]] > 0.5).sum(axis=1) >= 2
    assert (got.tp, got.fp, got.fn) == ((says & (f.y == 1)).sum(), (says & (f.y == 0)).sum(), (~says & (f.y == 1)).sum())
    best = ensemble.greedy_selection(p, 3)
    assert [b["step"] for b in best] == [1, 2, 3] and best[-1]["subset"] == 7


def test_interval(spark):
    rows = [(1, i, f, 1) for i, f in enumerate([False, True, True, False, True])] + [(2, i, False, 3) for i in range(5)] + [(3, i, i == 0, 2) for i in range(4)]
    got = {r.g: (r.low, r.high) for r in ranking.contiguous_interval(frame(spark, rows, "g int, i int, f boolean, a int"), ("g",), "i", "f", "a").collect()}
    assert got == {1: (1, 2), 2: (3, 3), 3: (2, 2)}


def test_student_t():
    for df, t, want in ((1, 1.0, 0.75), (5, 2.015, 0.95), (10, 2.228, 0.975), (30, -1.697, 0.05)):
        assert abs(float(student.cdf(t, df)) - want) < 2e-4
    assert abs(float(student.ppf(0.975, 6)) - 2.446912) < 1e-5


def test_tost_few_pairs(spark):
    rows = [(1, p, i, i / 10, 0.5 + i / 100 + p / 1000) for p in range(4) for i in range(3)]
    got = threshold.tost(frame(spark, rows, "m int, pair int, t_idx int, threshold double, value double"), ["m"]).collect()
    assert all(r.equivalent and r.skipped and r.p_lower is None for r in got)


def test_tost_and_recommendation(spark):
    rng = np.random.default_rng(6)
    rows = [(1, p, i, i / 10, float(0.8 - 0.05 * (i - 5) ** 2 / 10 + 0.002 * rng.normal())) for p in range(8) for i in range(10)]
    df = frame(spark, rows, "m int, pair int, t_idx int, threshold double, value double")
    got = threshold.tost(df, ["m"], delta=0.02).orderBy("t_idx").toPandas()
    assert got.equivalent[4:7].all() and not got.equivalent[0] and not got.equivalent[9]
    r = threshold.recommend(df, ["m"], delta=0.02).first()
    assert 0.4 <= r.recommended_t <= 0.6 and r.tost_interval.startswith("[0.") and "/" in r.sign_consistency


def test_bootstrap(spark):
    px = frame(spark, [(1, 1 + i % 4) for i in range(400)], "scene int, code int")
    got = sampling.bootstrap(px, ["scene"], 200, 100).toPandas()
    assert ((got.tp + got.fp + got.fn + got.tn) == 100).all() and abs(got.tp.mean() - 25) < 1.5
    with pytest.raises(Exception, match="larger than the pool"):
        sampling.bootstrap(px, ["scene"], 2, 1000).collect()


def test_kde2_is_a_density(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, [(1, float(a), float(b)) for a, b in rng.normal(size=(300, 2))], "g int, x double, y double")
    grid = [-4 + 0.5 * i for i in range(17)]
    got = sampling.kde2(df, ["g"], "x", "y", grid, grid).toPandas()
    assert abs(got.density.sum() * 0.25 - 1) < 0.05


def test_lines(spark):
    line = [(0, [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)]), (1, [(1.0, 1.0)]), (2, [(2.0, 2.0), (2.0, 2.0)])]
    df = frame(spark, line, "contour_id int, vertices array<struct<x: double, y: double>>")
    kept = geometry.valid_lines(df).collect()
    assert [(r.contour_id, r.length) for r in kept] == [(0, 11.0)]
    dense = df.where("contour_id = 0").select(geometry.densify("vertices", 1.0).alias("v")).first().v
    steps = [math.hypot(b.x - a.x, b.y - a.y) for a, b in zip(dense, dense[1:])]
    assert max(steps) <= 1 + 1e-9 and abs(sum(steps) - 11) < 1e-9
    bent = frame(spark, [(0, [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 2.0)])], "contour_id int, vertices array<struct<x: double, y: double>>")
    assert len(bent.select(geometry.simplify(0.1)("vertices").alias("v")).first().v) == 3


def test_contour_of_a_disc_is_one_closed_line(spark):
    rows = [(0, r, c, float(5 - math.hypot(r - 10, c - 10))) for r in range(21) for c in range(21)]
    seg = geometry.iso_segments(frame(spark, rows, "scene int, r int, c int, p double"), 0.0)
    lines = geometry.valid_lines(chaining.contour_lines(chaining.contour_parts(seg))).collect()
    assert len(lines) == 1 and abs(lines[0].length - 2 * math.pi * 5) < 0.3
    assert lines[0].vertices[0] == lines[0].vertices[-1]


def test_overlay_rules(spark):
    df = frame(spark, [(1, 1, 1), (255, 1, 1), (0, 0, 1)], "ref int, msk int, k int")
    assert overlay.valid_pixels(df, "ref", (255,), "msk").count() == 1
    assert overlay.valid_pixels(df, "ref", ()).count() == 3
    with pytest.raises(Exception, match="no valid pixels in a"):
        overlay.require_valid(frame(spark, [("a", 0)], "s string, n_valid long"), ["s"]).collect()
    t = frame(spark, [([10.0, 0.0, 5.0, 0.0, -10.0, 7.0], [10.0, 0.0, 7.0, 0.0, -10.0, 6.0])], "a array<double>, b array<double>")
    d = overlay.transform_diff(t, "a", "b", F.lit(False), F.lit(0.0)).first()
    assert (d.max_abs_diff, d.max_diff_m, round(d.max_diff_px, 6)) == (2.0, 2.0, 0.2)


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(S.edge_bin(F.lit(0.3), S.linspace(0.0, 1.0, 11))).first()[0] in (2, 3)
    assert one.select(S.threshold_probability(F.lit(float("nan")), 0.5)).first()[0] == 0
    assert one.select(S.sanitize_for_path(F.lit("  .. "))).first()[0] in ("pp", "unknown")
    assert one.select(S.scene_date(F.lit("x"))).first()[0] == "x"
    with pytest.raises(ValueError):
        S.threshold_probability("p", 0.5, "equal")
    with pytest.raises(ValueError, match="missing columns: b"):
        require_columns(one.withColumn("a", F.lit(1)), ["a", "b"])


def test_sanity_gate(spark):
    a = frame(spark, [("m", 0.5), ("n", 0.7)], "model string, iou double")
    b = frame(spark, [("m", 0.5005), ("n", 0.8)], "model string, iou double")
    got = {r.model: r.ok for r in ranking.sanity_gate(a, b, ["model"]).collect()}
    assert got == {"m": True, "n": False}


def test_raw_tiles(spark, tmp_path):
    from gridmetric.sources.raw_tiles import RawTileSource

    x = np.random.default_rng(0).normal(size=(10, 3, 4, 4)).astype("<f4")
    x[:, 2] = 1
    x.tofile(tmp_path / "a.bin")
    spark.dataSource.register(RawTileSource)
    read = lambda p, **o: spark.read.format("rawtile").options(height=4, width=4, recordsPerPartition=3, **o).load(str(p))
    got = read(tmp_path / "a.bin").orderBy("chip_id").collect()
    assert len(got) == 10 and np.allclose(got[7].vv, x[7, 0].ravel()) and got[0].mask == [1] * 16
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="positive number of records"):
        read(tmp_path / "bad.bin").count()
    (tmp_path / "many" / "train").mkdir(parents=True)
    x[:4].tofile(tmp_path / "many" / "train" / "a, b.bin")
    x[4:].tofile(tmp_path / "many" / "train" / "c.bin")
    both = read(tmp_path / "many", splits='["train", "val"]').orderBy("chip_id").collect()
    assert [r.chip_id for r in both] == list(range(10)) and {r.split for r in both} == {"train"} and np.allclose(both[7].vv, x[7, 0].ravel())
    assert read(tmp_path / "many", splits='["val"]').count() == 0


def test_raw_tile_writer(spark, tmp_path):
    """Rows in order over several tasks and splits, appended and overwritten; a failed write changes nothing."""
    from gridmetric.sources.raw_tiles import RawTileSource, RawTileWriter, Written

    spark.dataSource.register(RawTileSource)
    rows = [(f"s{k // 25}", [float(k + i) for i in range(4)], [float(-k)] * 4, [k % 2] * 4) for k in range(60)]
    df = frame(spark, rows, "split string, vv array<float>, vh array<float>, mask array<short>").repartitionByRange(4, F.get("vv", F.lit(0)))
    where = str(tmp_path / "raw")
    save = lambda d, mode, **o: d.write.format("rawtile").options(height=2, width=2, **o).mode(mode).save(where)
    load = lambda: spark.read.format("rawtile").options(height=2, width=2, recordsPerPartition=7).load(where).orderBy("split", "chip_id").collect()
    save(df.sortWithinPartitions("split", F.get("vv", F.lit(0))), "append")
    first = load()
    assert [(r.split, r.vv, r.vh, r.mask) for r in first] == rows and [r.chip_id for r in first] == [*range(25), *range(25), *range(10)]
    assert not list((tmp_path / "raw").glob("_*"))
    save(df.where("split = 's2'"), "append")
    assert [r.chip_id for r in load() if r.split == "s2"] == list(range(20)) and [r.vv[0] for r in load() if r.split == "s2"][:10] == [float(k) for k in range(50, 60)]
    bad = df.withColumn("vv", F.when(F.get("vv", F.lit(0)) == 30, F.array()).otherwise(F.col("vv")))
    seen = lambda: sorted(str(p) for p in (tmp_path / "raw").rglob("*.bin"))  # noqa: E731  tasks that are still being killed may be at work below _temporary
    files, rows_before = seen(), load()
    with pytest.raises(Exception, match="2 x 2 values"):
        save(bad, "append")
    assert seen() == files and load() == rows_before
    save(df.where("split = 's0'"), "overwrite")
    assert {r.split for r in load()} == {"s0"} and len(load()) == 25
    # Of two attempts of a task one counts: what the other wrote goes.
    writer = RawTileWriter({"path": where, "height": "1", "width": "2", "planes": "1"}, True)
    left = tmp_path / "raw" / "_temporary" / writer.job
    for attempt in ("one", "two"):
        (left / attempt).mkdir(parents=True)
        np.array([1.0, 2.0], "<f4").tofile(left / attempt / "0")
    writer.commit([Written(0, [(str(left / "two" / "0"), "")]), None])
    assert [p.name for p in (tmp_path / "raw").rglob("*.bin")] == ["0000-000000-0000.bin"] and not left.exists()


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.tif\n\n# no\n b.tif\n")
    assert [r.path for r in files.input_images(spark, str(tmp_path / "list.txt")).collect()] == ["a.tif", "b.tif"]
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), "a int, b string", ["a"]).count() == 0
    paths = frame(spark, [("/r/unet_tta/s1/x.tif",)], "path string")
    r = files.discover(paths, {"_tta": "tta"}).first()
    assert (r.model, r.base, r.tiling, r.scene) == ("unet_tta", "unet", "tta", "s1")
    with pytest.raises(Exception, match="unknown tiling"):
        files.discover(paths, {"_x": "x"}).collect()
    files.append_manifest(frame(spark, [("r",)], "run_id string"), str(tmp_path / "m"), "run_id string, status string, n int")
    assert spark.read.parquet(str(tmp_path / "m")).first().asDict() == {"run_id": "r", "status": "", "n": None}
    assert files.validated_copy(paths, str(tmp_path / "c")) == 1
    line = frame(spark, [(1, [(0.0, 1.0), (2.0, 3.0)])], "contour_id int, vertices array<struct<x: double, y: double>>")
    assert '"coordinates":[[0.0,1.0],[2.0,3.0]]' in files.geojson_lines(line).first().value
    (tmp_path / "run__20240101T000000Z").mkdir()
    (tmp_path / "run__20240101T000000Z" / "s.csv").write_text("a\n1\n")
    assert files.collate(spark, str(tmp_path / "run__*" / "s.csv"), "a int").first().run_name == "run"


def test_streamed_histogram_equals_batch(spark, tmp_path):
    from gridmetric.streaming.calibration import accumulate, stream_scores

    px = frame(spark, [("m", i % 2, i / 50) for i in range(50)], "model_name string, y int, p double")
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    q = accumulate(stream_scores(spark, str(tmp_path / "in"), "model_name string, y int, p double"), ["model_name"], "hist", str(tmp_path / "ck"), 20)
    q.awaitTermination(120)
    a, b = (x.orderBy("bin").toPandas() for x in (spark.table("hist"), calibration.fine_histogram(px, ["model_name"], 20)))
    pd.testing.assert_frame_equal(a.round(9), b.round(9))

def test_bounds_intersection_takes_all_extents(spark, tmp_path):
    from gridmetric.plans import relations

    rng = np.random.default_rng(4)
    rows = [(int(k), float(q), float(p)) for k in range(1, 71) for q, p in zip(rng.uniform(1, 60, 2), rng.uniform(100, 900, 2) * (1 + k % 5))]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    own = {k: [[r[i] for r in rows if r[0] == k] for i in (1, 2)] for k in range(1, 71)}
    box = {k: (min(q) + k % 40, min(p), max(q) - k % 7, max(p) / 2) for k, (q, p) in own.items()}
    want = {}
    for a in box:
        for b in box:
            left, bottom, right, top = *map(max, box[a][:2], box[b][:2]), *map(min, box[a][2:], box[b][2:])
            if a < b and left < right and bottom < top:
                want[a, b] = (left, bottom, right, top)
    got = relations.bounds_intersection(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.ka, r.kb): (r.left_, r.bottom, r.right_, r.top) for r in got} == want
    assert any(b >= 40 for _, b in want) and len(want) < 70 * 69 / 2


def _embeddings(spark, path, n):
    rng = np.random.default_rng(6)
    rows = [(k, 0, [float(v) for v in rng.normal(size=64).astype("f4")]) for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return {k: np.array(v) for k, _, v in rows}


def test_coverage_gaps_of_the_whole_canvas(spark, tmp_path):
    from gridmetric.plans import tiles as plans

    ids = _embeddings(spark, tmp_path, 705)  # 36 rows of tiles, the last with 5
    covered = {(k // 20 * 4 + i, k % 20 * 4 + j) for k in ids if k % 7 for i in range(8) for j in range(8)}
    got = [tuple(r) for r in plans.coverage_gaps(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({(r, c) for r in range(148) for c in range(84)} - covered) and max(got)[0] > 104


def test_raw_tile_scan_reads_all_chips(spark, tmp_path):
    from gridmetric.plans import tiles as plans

    chips = _embeddings(spark, tmp_path, 50)
    got = plans.raw_tile_scan(spark, str(tmp_path)).collect()
    assert len(got) == 50 == len({(r.split, r.chip_id) for r in got}) and {r.n for r in got} == {64}
    want = sorted((v.sum(), int((v > 0).sum())) for v in chips.values())
    assert np.allclose(sorted((r.vv_sum, r.water) for r in got), want, atol=1e-3)
