"""Steps that must not grow with a group: numbers of pixels, pairs of extents, and what the driver gets."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_within_groups_equal_a_window_over_the_whole_group(spark):
    from gridmetric.operators.ranking import number_within

    rng = random.Random(3)
    key = lambda i: None if i % 97 == 0 else 5 if i % 3 == 0 else rng.choice([-(2**62), 2**62, rng.randrange(-1000, 1000)])
    rows = [(None if i % 50 == 0 else i % 4, key(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, k long, i long").repartition(5)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")) - 1)
    got = number_within(df, F.col("g"), ("k", "i"), "n")
    assert got.columns == want.columns and sorted(map(tuple, got.select("i", "n").collect())) == sorted(map(tuple, want.select("i", "n").collect()))
    assert number_within(df.limit(0), F.col("g"), ("k", "i"), "n").collect() == []
    assert {r.n for r in number_within(df.where("i % 97 = 0"), F.lit(1), ("k", "i"), "n").collect()} == set(range(31))


def test_no_task_numbers_a_whole_scene(spark, data, apart):
    from gridmetric.sources import fixtures

    rows = fixtures.pxw(spark, data, "scene", "pix").select(F.spark_partition_id().alias("p"), "scene", "pix").collect()
    held = Counter(r.p for r in rows)
    assert max(held.values()) < len(rows) / 14  # a scene has a seventh


def test_extents_on_one_spot_are_dealt_over_tasks(spark, apart, monkeypatch):
    from gridmetric.operators import overlay

    monkeypatch.setattr(overlay, "PART", 32, raising=False)
    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(9, 10), rng.uniform(9, 10)) for k in range(400)]
    rows += [(1000 + k, 100.0 * k, -5.0, 100.0 * k + rng.choice([1, 30, 4000]), 5.0) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, left double, bottom double, right double, top double").repartition(4)
    pairs = overlay.overlapping_extents(df).select(F.spark_partition_id().alias("p"), "a_k", "b_k", "left", "bottom", "right", "top").collect()
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            box = (max(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3]), min(x[4], y[4]))
            if box[0] < box[2] and box[1] < box[3]:
                want[x[0], y[0]] = box
    assert len(pairs) == len(want) and {(r.a_k, r.b_k): (r.left, r.bottom, r.right, r.top) for r in pairs} == want
    assert max(Counter(r.p for r in pairs).values()) < len(pairs) / 5


def test_the_exchange_of_crowded_cells_grows_with_the_extents(spark, monkeypatch):
    """Not with the square of them, as their pairs do; extents of many sizes, so that every kind of entry is dealt."""
    from gridmetric.operators import overlay

    monkeypatch.setattr(overlay, "PART", 8)
    rng = random.Random(9)
    rows = []
    for k in range(300):
        x, y, w, h = rng.uniform(0, 40), rng.uniform(0, 40), 30 * rng.random() ** 3 + 0.1, 30 * rng.random() ** 3 + 0.1
        rows.append((k, x, y, x + w, y + h))
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 50.0, 50.0)], "k long, left double, bottom double, right double, top double")
    dealt, real = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: dealt.append(self) or real(self, *a))
    got = sorted(map(tuple, overlay.overlapping_extents(df).collect()))
    want = []
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            box = (max(x[1], y[1]), max(x[2], y[2]), min(x[3], y[3]), min(x[4], y[4]))
            if box[0] < box[2] and box[1] < box[3]:
                want.append((x[0], y[0], *box))
    assert got == want and dealt
    sent = []
    for n in (500, 2000):
        dealt.clear()
        overlay.overlapping_extents(spark.range(n).selectExpr("id AS k", "id / 1e6D AS left", "0D AS bottom", "9D + id / 1e6D AS right", "10D AS top"))
        sent.append(sum(d.count() for d in dealt))
    assert 0 < sent[0] and sent[1] < 5 * sent[0]


def test_cells_are_sent_as_one_number_each(spark):
    """The exchange of a wide table is the rows of its cells, so that their width is its size."""
    from gridmetric.operators import overlay

    df = spark.createDataFrame([(k, 10.0 * k, 0.0, 10.0 * k + 12, 1.0) for k in range(50)], "k long, left double, bottom double, right double, top double")
    found = overlay.overlapping_extents(df)
    assert "hashpartitioning(cell#" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 49


def test_runs_of_contours_meet_without_the_driver(spark):
    from gridmetric.operators import chaining

    rows = [(1, 0, c, c, c + 1, float(c), 0.0, float(c + 1), 0.0) for c in range(40)]
    segments = spark.createDataFrame(rows, "scene int, r int, c int, e1 long, e2 long, x1 double, y1 double, x2 double, y2 double")
    parts = chaining.contour_parts(segments, block=8)
    assert "BroadcastHashJoin" not in parts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.contour_id, r.part, r.n) for r in parts.collect()) == [(0, k, 8) for k in range(5)]


def test_subsample_orders_only_the_least_hashes(spark):
    from gridmetric.operators.sampling import subsample

    df = spark.range(20_000).selectExpr("IF(id % 7 = 0, NULL, id % 3) AS g", "id AS i")
    w = Window.partitionBy("g").orderBy(F.xxhash64(F.lit(42), "i"), "i")
    want = df.withColumn("n", F.row_number().over(w)).where("n <= 100").select("g", "i")
    got = subsample(df, ("g",), ("i",), 100)
    assert got.columns == ["g", "i"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def test_the_stacker_scores_all_scenes_in_one_pass(spark):
    from gridmetric.operators.ensemble import logistic_stacker

    wide = spark.range(600).selectExpr("CAST(id % 3 AS INT) AS scene", "IF(id % 5 < 2, 1, 0) AS y", "(id % 5) / 5.0D + (id % 11) / 50.0D AS a", "(id % 13) / 13.0D AS b")
    out = logistic_stacker(wide, ["a", "b"])
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 600 and sum((r.p < 0.5) == (r.y == 1) for r in rows) < 120


def _plain_fit(x, y, n):
    """Weights, the intercept last, of a logistic regression with C = 1 on rows that occur n times, by plain Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty, w = np.append(np.ones(x.shape[1] - 1), 0.0), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (p - y)) + penalty * w)
    assert np.abs(x.T @ (n * (1 / (1 + np.exp(-(x @ w))) - y)) + penalty * w).max() < 1e-6 * n.sum()
    return w


def test_the_stacker_learns_from_every_row_of_the_other_scenes(spark):
    from gridmetric.operators.ensemble import logistic_stacker

    columns = ["CAST(id % 2 AS INT) AS scene", "CAST(pmod(hash(id % 286), 10) < id % 22 div 2 AS INT) AS y", "(id % 22 div 2) / 11.0D AS a", "(id % 26 div 2) / 13.0D + id % 2 AS b"]
    wide = spark.range(900_900).selectExpr(*columns)  # 450,450 rows a scene, each 3,150 times
    few = np.array(spark.range(286).selectExpr(*columns).collect(), dtype=float)
    got = sorted(map(tuple, logistic_stacker(wide, ["a", "b"]).groupBy("scene", "y", "p").count().collect()))
    want = []
    for s in (0, 1):
        other, own = few[few[:, 0] != s], few[few[:, 0] == s]
        w = _plain_fit(other[:, 2:], other[:, 1], np.full(len(other), 3150.0))
        want += [(s, int(r[1]), 1 / (1 + np.exp(-(r[2:] @ w[:2] + w[2]))), 3150) for r in own]
    want.sort()
    assert len(got) == len(want) == 286 and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-8 and g[3] == w[3] for g, w in zip(got, want))


def test_tuned_stacker_thresholds_come_from_every_row(spark, data, tmp_path):
    """Two scenes of more than 300,000 pixels each, equal ones many times; models and thresholds are those of a plain fit by counts."""
    from gridmetric.plans import runs
    from gridmetric.sources import fixtures

    copies = 2000
    line = fixtures.lineitem(spark, data).where("year(l_shipdate) IN (1996, 1997) AND l_returnflag <> 'N' AND l_linestatus = 'O'")
    line.crossJoin(spark.range(copies).select()).write.parquet(str(tmp_path / "lineitem.parquet"))
    few = fixtures.pxw_valid(spark, data, "scene", "y", *(f"p_{k}" for k in range(fixtures.N))).where("scene IN (1996, 1997)")
    few = np.array(few.select("scene", "y", *(f"p_{k}" for k in range(fixtures.N))).collect(), dtype=float)
    assert min((few[:, 0] == s).sum() for s in (1996, 1997)) * copies > 450_000
    edges, tp, fp, n = np.linspace(0, 1, 101)[:-1], {}, {}, {}
    for s in (1996, 1997):
        other, own = few[few[:, 0] != s], few[few[:, 0] == s]
        w = _plain_fit(other[:, 2:], other[:, 1], np.full(len(other), float(copies)))
        p, y = 1 / (1 + np.exp(-(own[:, 2:] @ w[:-1] + w[-1]))), own[:, 1]
        tp[s], fp[s], n[s] = ([int(copies * (c & (p >= e)).sum()) for e in edges] for c in (y == 1, y == 0, y >= 0))
    want = {}
    for s, other in ((1996, 1997), (1997, 1996)):
        b = int(np.argmax(np.round([t / (f + tp[other][0]) for t, f in zip(tp[other], fp[other])], 9)))
        want[s] = (b, tp[s][b], fp[s][b], tp[s][0] - tp[s][b])
    got = {r.held_out: (r.bin, r.tp, r.fp, r.fn) for r in runs.logreg_stacker_tuned(spark, str(tmp_path)).collect()}
    assert got == want


def test_the_stacker_on_odd_inputs(spark):
    from gridmetric.operators.ensemble import logistic_stacker

    ddl = "scene string, y int, a double"
    rows = [(s, (i * 7 % 5) // 3, i / 10) for s in ("x", None, "z") for i in range(10)]
    stack = lambda r: logistic_stacker(spark.createDataFrame(r, ddl), ["a"]).collect()
    found = stack(rows)
    assert len(found) == 30 and {r.scene for r in found} == {"x", None, "z"} and len({round(r.p, 9) for r in found}) == 10  # null is a scene; equal scenes, equal models
    assert {(r.scene, r.p) for r in stack([("x", 1, 0.5), ("x", 1, 0.1), ("z", 0, 0.3)])} == {("x", 0.0), ("z", 1.0)}  # others of one class
    assert stack([]) == []
    for bad in (rows[:10], [*rows, ("x", 2, 0.5)], [*rows, ("x", None, 0.5)], [*rows, ("x", 1, None)], [*rows, ("x", 1, float("inf"))]):
        with pytest.raises(Exception):
            stack(bad)


def test_tasks_of_numbering_joins_and_blocks_grow_with_the_rows(spark, monkeypatch):
    """A task has about ROWS rows, whatever the session's number of shuffle partitions; numbers and blocks are the same."""
    from gridmetric.operators import blocks, ranking

    df = spark.range(20_000).selectExpr("id % 3 AS g", "id * 7919 % 20011 AS k")
    want = sorted(map(tuple, ranking.number_within(df, F.col("g"), ("k",), "n", ranges=16).collect()))
    pixels = spark.range(20_000).selectExpr("'s' AS scene", "CAST(id div 100 AS INT) AS r", "CAST(id % 100 AS INT) AS c", "id AS p")
    sizes = spark.createDataFrame([("s", 200, 100)], "scene string, height int, width int")
    whole = sorted(map(tuple, blocks.raster_blocks(pixels, sizes, 10, "p").collect()))
    monkeypatch.setattr(ranking, "ROWS", 500)
    most = lambda d: max(d.rdd.glom().map(len).collect())
    got = ranking.number_within(df, F.col("g"), ("k",), "n", ranges=16)
    assert sorted(map(tuple, got.collect())) == want and most(got) < 2000
    dealt = blocks.raster_blocks(pixels, sizes, 10, "p", rows=20_000)
    assert sorted(map(tuple, dealt.collect())) == whole and most(dealt) < 20
    a, b = ranking.deal(df, 20_000, "k"), ranking.deal(df.where("g = 1"), 20_000, "k")
    both = a.hint("merge").join(b.select("k", F.lit(1).alias("x")), "k")
    assert most(a) < 2000 and both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
