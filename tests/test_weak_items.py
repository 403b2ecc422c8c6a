"""Binned densities, bootstrap from counts, copies by content, overlapping extents, extraction by batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmetric.operators import chaining, overlay, sampling
from gridmetric.sources import files


def test_binned_densities_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    u = rng.normal(size=2000)
    v = 0.8 * u + 0.3 * rng.normal(size=2000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(u, v)] + [(1, float("nan"), 1.0), (1, None, 2.0), (2, 0.0, 0.0)], "g int, x double, y double")
    grid = [-3 + 0.25 * i for i in range(25)]
    h = u.std(ddof=1) * len(u) ** -0.2
    exact = np.exp(-(((np.array(grid)[:, None] - u) / h) ** 2) / 2).sum(axis=1) / (len(u) * h * np.sqrt(2 * np.pi))
    for steps in (4, 32):
        got = {r.at: r.density for r in sampling.kde(df, ["g"], "x", grid, steps=steps).collect()}
        assert np.abs(np.array([got[a] for a in grid]) - exact).max() <= 1 / (8 * steps**2) / (h * np.sqrt(2 * np.pi)) + 1e-9
    cov = np.cov(u, v) * len(u) ** (-1 / 3)
    inv, peak = np.linalg.inv(cov), 1 / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    got = {(r.at_x, r.at_y): r.density for r in sampling.kde2(df, ["g"], "x", "y", grid[::4], grid[::4]).collect()}
    for (a, b), density in got.items():
        d = np.stack([a - u, b - v])
        assert abs(density - peak * np.exp(-(d * (inv @ d)).sum(axis=0) / 2).mean()) <= peak / (4 * 32**2) + 1e-9
    assert len(got) == 49


def test_bootstrap_from_counts(spark):
    """Moments of a multinomial, the same draws however rows are dealt, and samples of any size."""
    counts = spark.createDataFrame([("a", 400, 100, 200, 300), ("b", 0, 0, 7, 0), (None, 10**12, 10**12, 10**11, 0)], "scene string, tn long, fp long, fn long, tp long")
    got = sampling.bootstrap_counts(counts, ["scene"], 2000, 5)
    rows = [r for r in got.collect() if r.scene == "a"]
    x = np.array([(r.tn, r.fp, r.fn, r.tp) for r in rows])
    p = np.array([0.4, 0.1, 0.2, 0.3])
    assert (x.sum(axis=1) == 5).all() and len({r.rep for r in rows}) == 2000
    assert np.abs(x.mean(axis=0) - 5 * p).max() < 0.1
    assert np.abs(np.cov(x.T) - 5 * (np.diag(p) - np.outer(p, p))).max() < 0.1
    again = sampling.bootstrap_counts(counts.repartition(7), ["scene"], 2000, 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    whole = sampling.bootstrap_counts(counts, ["scene"], 3).collect()
    assert {r.scene: r.tn + r.fp + r.fn + r.tp for r in whole} == {"a": 1000, "b": 7, None: 2 * 10**12 + 10**11}
    assert all(r.fn == 7 for r in whole if r.scene == "b") and all(r.tp == 0 for r in whole if r.scene is None)
    with pytest.raises(Exception, match="larger than the pool"):
        sampling.bootstrap_counts(counts, ["scene"], 1, 8).collect()


def test_copies_agree_in_content(spark, tmp_path, monkeypatch):
    rows = [(k, f"v{k % 3}", None if k % 4 else float(k), [k, None], {"a": k}) for k in range(50)] + [(1, "v1", None, [1, None], {"a": 1})]
    df = spark.createDataFrame(rows, "k int, `a.b` string, x double, l array<int>, m map<string,int>")
    source, to = str(tmp_path / "from"), str(tmp_path / "to")
    df.write.parquet(source)
    own = spark.read.parquet(source)
    assert files.validated_copy(own.repartition(3), to) == 51
    sums = lambda d: d.agg(*files.content_sums(d)).first()
    assert sums(own) == sums(own.orderBy(F.desc("k"))) == sums(spark.read.parquet(to))
    for changed in (own.withColumn("x", F.when(F.col("k") == 8, 9.0).otherwise(F.col("x"))), own.withColumn("x", F.when(F.col("k") == 8, None).otherwise(F.col("x"))), own.dropDuplicates(["k"]).union(own.limit(1))):
        assert sums(changed) != sums(own)
    # What is read back has one value changed: an error, and source and target stay as they were.
    real = files.content_sums
    monkeypatch.setattr(files, "content_sums", lambda d: real(d.withColumn("k", F.col("k"))) if d is not own else [*real(d)[:2], F.lit("0").alias("h1")])
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(ValueError, match="differs from the source"):
        files.validated_copy(own, to, source)
    monkeypatch.undo()
    assert sorted(p.name for p in tmp_path.iterdir()) == before and spark.read.parquet(source).count() == 51
    other = str(tmp_path / "other")
    assert files.validated_copy(spark.read.parquet(source), other, source) == 51 and not (tmp_path / "from").exists() and spark.read.parquet(other).count() == 51


def test_overlapping_extents_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(220):
        scale = 10.0 ** rng.integers(-2, 4)
        x, y = rng.uniform(-500, 500, 2)
        rows.append((k, float(x), float(y), float(x + scale * rng.random()), float(y + scale * rng.random())))
    rows += [(900, 0.0, 0.0, 0.0, 5.0), (901, -1e4, -1e4, 1e4, 1e4), (902, 8.0, 8.0, 16.0, 16.0), (903, 16.0, 8.0, 24.0, 16.0), (904, 8.0, 8.0, 16.0, 16.0)]
    df = spark.createDataFrame(rows, "k int, left double, bottom double, right double, top double")
    got = sorted(tuple(r) for r in overlay.overlapping_extents(df).collect())
    want = []
    for a in rows:
        for b in rows:
            box = (max(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), min(a[4], b[4]))
            if a[0] < b[0] and box[0] < box[2] and box[1] < box[3] and a[1] < a[3] and b[1] < b[3]:
                want.append((a[0], b[0], *box))
    assert got == sorted(want)
    assert overlay.overlapping_extents(df.limit(0)).count() == 0


def test_extraction_skips_resumes_and_overwrites(spark, tmp_path):
    rows = [(k, r, c, float(3 + k - np.hypot(r - 6, c - 6))) for k in range(5) for r in range(13) for c in range(13)]
    canvas = spark.createDataFrame(rows, "scene int, r int, c int, p double")
    root = str(tmp_path / "out")
    run = lambda df=canvas, **o: {r.scene: r.action for r in chaining.extract_contours(df, root, 0.0, at_once=2, block=4, **o).collect()}
    lines = lambda: {r.scene: (r.n, round(r.l, 6)) for r in spark.read.parquet(f"{root}/lines").groupBy("scene").agg(F.sum("n").alias("n"), F.sum("length").alias("l")).collect()}
    assert set(run(dry_run=True).values()) == {"would_extract"} and not (tmp_path / "out").exists()
    assert run(canvas.where("scene < 3")) == {k: "extract" for k in range(3)}
    first = lines()
    assert run() == {0: "skip", 1: "skip", 2: "skip", 3: "extract", 4: "extract"}
    whole = lines()
    assert {k: whole[k] for k in range(3)} == first and set(whole) == set(range(5)) and set(run().values()) == {"skip"}
    # A run that ended between lines and marker: those scenes are written again, once.
    import shutil

    shutil.rmtree(tmp_path / "out" / "done")
    assert set(run().values()) == {"extract"} and lines() == whole
    assert set(run(overwrite=True).values()) == {"extract"} and lines() == whole
