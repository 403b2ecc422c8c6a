"""Manifests, shared folders, ranks by ranges and the checks on inputs."""

import json
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmetric.operators import ensemble, manifest, ranking, sampling, tiles
from gridmetric.plans import tiles as plans
from gridmetric.sources import fixtures, shared


def test_rank_all_equals_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in enumerate(rng.integers(0, 50, 500))]
    got = ranking.rank_all(spark.createDataFrame(rows, "k long, v double"), (F.desc("v"), "k")).collect()
    assert {r.k: r["rank"] for r in got} == {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert ranking.rank_all(spark.createDataFrame([], "k long, v double"), ("v", "k")).count() == 0


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 1.0])
def test_sorted_subset_is_the_least_by_hash(spark, ratio):
    rows = [(k, k * 7919 % 101) for k in range(400)]
    got = sampling.sorted_subset(spark.createDataFrame(rows, "k long, h long"), ["k"], ratio, F.col("h"), 101, bins=10).collect()
    assert sorted(r.k for r in got) == sorted(k for k, _ in sorted(rows, key=lambda x: (x[1], x[0]))[: int(400 * ratio)])


def test_naive_forms_equal_the_others(spark, data):
    scores = [f"p_{k}" for k in range(fixtures.N)]
    wide = fixtures.pxw_valid(spark, data, "scene", "y", *scores)
    a = {r.subset: (r.tp, r.fp, r.fn) for r in ensemble.naive_votes(wide, scores).collect()}
    b = {r.subset: (r.tp, r.fp, r.fn) for r in ensemble.exhaustive_votes(ensemble.pattern_table(wide, scores), fixtures.N).collect()}
    assert a == b
    px = plans.pixels(spark, data)
    x, y = ({(r.r, r.c): r.p for r in f(px, 8).collect()} for f in (tiles.naive_stitch, tiles.stitch_weighted))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)


def test_overrides_fills_and_policies():
    config = {"a": {"b": 1}, "c": 2}
    assert manifest.merge_overrides(config, {"a.b": 5, "a.d.e": 6, "c": None}) == {"a": {"b": 5, "d": {"e": 6}}, "c": 2} and config == {"a": {"b": 1}, "c": 2}
    assert manifest.channel_fills("constant", None, 2, 7.0) == [7.0, 7.0]
    for means in (None, [1.0]):
        with pytest.raises(ValueError, match="channel means"):
            manifest.channel_fills("training_channel_mean", means, 2)
    assert manifest.checked_policy("exact") == "exact"
    with pytest.raises(ValueError):
        manifest.checked_policy("near")


def test_unaligned_rows_are_errors(spark):
    rows = [("a", "E1", "E1", "s", "s", 0.1), ("b", "E1", None, "s", "s", 0.1), ("c", "E1", "E1", "s", "t", 0.1), ("d", "E1", "E1", "s", "s", 0.6), ("e", "E1", "E1", "s", "s", None)]
    x = manifest.alignment_status(spark.createDataFrame(rows, "name string, crs_a string, crs_b string, shape_a string, shape_b string, max_diff_px double"))
    assert [r.status for r in x.orderBy("name").collect()] == ["aligned", "crs_mismatch", "shape_mismatch", "transform_mismatch", "transform_mismatch"]
    assert manifest.require_aligned(x.where("name = 'a'"), ["name"]).count() == 1
    with pytest.raises(Exception, match="c: shape_mismatch"):
        manifest.require_aligned(x.where("name = 'c'"), ["name"]).collect()


def test_shared_folders(spark, tmp_path):
    session = lambda master: types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master), conf=types.SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.scratch_folder(session(master), "x")
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "m int, s string, v int")
    path = str(tmp_path / "out")
    shared.write_missing(df.where("v = 5").withColumn("v", F.lit(0)), path, ["m", "s"])
    shared.write_missing(df, path, ["m", "s"])
    assert sorted((r.m, r.s, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a", 0), (1, "b", 6), (2, "a", 7)]
    dry = shared.clean_up(spark, [f"{path}/m=1", f"{path}/m=9"], dry_run=True).collect()
    assert [(r.existed, r.deleted) for r in dry] == [(True, False), (False, False)] and dry[0].bytes > 0
    done = shared.clean_up(spark, [f"{path}/m=1"])
    assert shared.freed_bytes(done).first().freed == dry[0].bytes and {r.m for r in spark.read.parquet(path).collect()} == {2}
    assert shared.newest_folder(spark, path) == "m=2" and shared.newest_folder(spark, str(tmp_path / "none")) is None


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": [1, {"b": None}]}))
    assert shared.load_config(str(tmp_path / "c.json")) == {"a": [1, {"b": None}]}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: [1, {b: null}]\n")
    assert shared.load_config(str(tmp_path / "c.yaml")) == {"a": [1, {"b": None}]}


def test_benchmark_loop_cleans_between_checkpoints(spark):
    seen = []
    rows = lambda n: spark.createDataFrame([(n, float(len(n)))], "name string, v double")
    out = manifest.benchmark_loop(["aa", "b"], lambda n: seen.append(("infer", n)) or rows(n), lambda df: df, lambda n: seen.append(("clean", n)), lambda df: df.orderBy("v"), lambda df, n: df)
    assert [r.name for r in out.collect()] == ["b", "aa"] and seen == [("infer", "aa"), ("clean", "aa"), ("infer", "b"), ("clean", "b")]
    with pytest.raises(ValueError):
        manifest.benchmark_loop([], None, None, None, None, None)


def test_one_band_rasters(spark, tmp_path):
    from gridmetric.sources.raw_tiles import RawTileSource

    x = np.arange(4 * 6, dtype="<f4").reshape(4, 6)
    x.tofile(tmp_path / "r.bin")
    spark.dataSource.register(RawTileSource)
    read = spark.read.format("rawtile").options(planes=1, height=2, width=3, recordsPerPartition=3)
    assert [r.band for r in read.load(f"file://{tmp_path}/r.bin").orderBy("chip_id").collect()] == x.tolist()
    with pytest.raises(Exception, match="three planes"):
        spark.read.format("rawtile").options(planes=2, height=2, width=3).load(f"{tmp_path}/r.bin").count()


def test_auc_of_many_scores(spark):
    """Scores within and beyond 0-1, with ties over ranges, against every pair."""
    from gridmetric.operators import auc

    rng = np.random.default_rng(8)
    p = np.round(rng.normal(0.5, 0.8, 400), 2)
    y = (rng.random(400) < 0.4).astype(int)
    got = auc.auc_summary(spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "m string, y int, p double"), ["m"]).first()
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))
    assert abs(got.roc_auc - want) < 1e-8
    ap, order = 0.0, sorted(set(p.tolist()), reverse=True)
    for cut in order:
        ap += (pos == cut).sum() / len(pos) * ((pos >= cut).sum() / (p >= cut).sum())
    assert abs(got.average_precision - ap) < 1e-8


def test_percentiles_from_counts(spark):
    from gridmetric.operators import metrics

    rng = np.random.default_rng(2)
    rows = [(k % 3, float(v)) for k, v in enumerate(np.round(rng.normal(size=200), 1))] + [(0, float("nan")), (1, None), (3, None), (4, 2.5)]
    got = {r.k: r for r in metrics.percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {0, 1, 2, 4} and (got[4].lo, got[4].mid, got[4].hi) == (2.5, 2.5, 2.5)
    for k in (0, 1, 2):
        own = [v for g, v in rows if g == k and v is not None and v == v]
        assert np.allclose([got[k].lo, got[k].mid, got[k].hi], np.percentile(own, [2.5, 50, 100]))


def test_simplified_lines_keep_rings_and_crossings(spark):
    from gridmetric.operators import geometry

    turn = np.linspace(0, 2 * np.pi, 60)
    ring = np.stack([10 * np.cos(turn), 10 * np.sin(turn)], axis=1)
    ring[-1] = ring[0]
    out = geometry._simplified(ring, 50.0)
    assert (out[0] == out[-1]).all() and len(out) >= 4
    spit = np.array([[0, 0], [10, 0], [10, 4], [5, 0.5], [0, 4], [0, 0.2], [4, 0.2]], float)
    assert not geometry._crosses(spit) and not geometry._crosses(geometry._simplified(spit, 3.0))
    assert geometry._crosses(np.array([[0, 0], [4, 4], [4, 0], [0, 4]], float)) and len(geometry._simplified(np.array([[0, 0], [1, 0.1], [2, 0]], float), 1.0)) == 2


def test_copies_remove_their_source_last(spark, tmp_path):
    from gridmetric.sources import files

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.range(10).write.parquet(old)
    assert files.validated_copy(spark.read.parquet(old), new, old) == 10
    assert spark.read.parquet(new).count() == 10 and not (tmp_path / "old").exists()
