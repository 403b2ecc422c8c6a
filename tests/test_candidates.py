"""Histograms of candidate scores in one pass, and simplification of long lines."""

from functools import reduce
from operator import add

import numpy as np
import pytest

from gridmetric.operators import auc, ensemble, geometry

SCORES = ["p_0", "p_1", "p_2"]


def _wide(spark, n=3000):
    rng = np.random.default_rng(6)
    p = np.round(rng.random((n, 3)), 3)
    p[::7] = np.round(p[::7], 2)  # on the edges of bins
    rows = [(int(s), int(y), *map(float, v)) for s, y, v in zip(rng.integers(0, 4, n), rng.integers(0, 2, n), p)]
    rows += [(0, 1, None, 0.5, 0.5), (1, 0, float("nan"), 1.0, 0.0), (2, 1, 2.0, 2.0, 2.0), (3, 0, -1.0, -1.0, -1.0), (None, 1, 0.1, 0.2, 0.3), (0, 1, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "scene int, y int, p_0 double, p_1 double, p_2 double")


def test_histograms_equal_curves_of_exploded_pixels(spark):
    wide = _wide(spark)
    made = {(c,): ensemble.mean_of(c) for c in (1, 3, 5, 7)}
    for held in (1, 64):
        hist = ensemble.candidate_histograms(wide, SCORES, made, ["subset"], ensemble.edge_bins(50), 50, held=held)
        got = {tuple(r) for r in auc.curves_of(hist, ["subset", "scene"], 50).where("scene IS NOT NULL").collect()}
        want = set()
        for c in (1, 3, 5, 7):
            own = [s for k, s in enumerate(SCORES) if c >> k & 1]
            for r in auc.score_curves(ensemble.soft_mean(wide, own), ["scene"], 50).where("scene IS NOT NULL").collect():
                want.add((c, *r))
        assert got == want


def test_counts_at_a_threshold_and_pairs(spark):
    wide = _wide(spark)
    rows = wide.collect()
    got = {r.subset: (r.tp, r.fp, r.fn) for r in ensemble.soft_counts(wide, SCORES, [3, 7], 0.4).collect()}
    for c, own in ((3, (2, 3)), (7, (2, 3, 4))):
        says = [all(r[k] is not None for k in own) and reduce(add, (r[k] for k in own)) / len(own) > 0.4 for r in rows]
        assert got[c] == tuple(sum(s == a and r.y == b for s, r in zip(says, rows)) for a, b in ((True, 1), (True, 0), (False, 1)))
    plan = ensemble.weighted_pair_curves(wide, SCORES, 20)
    keys = {(r.a, r.b, r.w10) for r in plan.select("a", "b", "w10").distinct().collect()}
    assert keys == {(a, b, w) for a in range(3) for b in range(a + 1, 3) for w in range(1, 10)}
    text = ensemble.soft_counts(wide, SCORES, [3, 7])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text
    assert ensemble.soft_counts(wide.limit(0), SCORES, [3]).count() == 0


# Simplification


def _all_pairs_cross(p):
    a, b = p[:-1], p[1:]
    side = lambda o, d, q: np.sign((d[:, None, 0] - o[:, None, 0]) * (q[None, :, 1] - o[:, None, 1]) - (d[:, None, 1] - o[:, None, 1]) * (q[None, :, 0] - o[:, None, 0]))
    s1, s2 = side(a, b, a), side(a, b, b)
    over = (s1 * s2 <= 0) & ((s1 * s2).T <= 0) & ((s1 != 0) | (s2 != 0) | (s1.T != 0) | (s2.T != 0))
    i, j = np.triu_indices(len(a), 2)
    ring = (i == 0) & (j == len(a) - 1) & bool((p[0] == p[-1]).all())
    return bool((over[i, j] & ~ring).any())


@pytest.mark.parametrize("n", [3, 4, 5, 8, 17, 60])
def test_crossings_equal_those_of_all_pairs(n):
    rng = np.random.default_rng(n)
    for _ in range(150):
        p = np.cumsum(rng.integers(-2, 4, (n, 2)), axis=0).astype(float)
        if rng.random() < 0.4:
            p[-1] = p[0]
        assert geometry._crosses(p) == _all_pairs_cross(p)
    assert {(int(i), int(j)) for a, b in geometry._meeting(np.zeros((n, 2)), 4) for i, j in zip(a, b)} == {(i, j) for i in range(n - 1) for j in range(i + 2, n - 1)}


def test_long_lines_stay_rings_without_crossings(spark):
    """100,000 points and more: a wavy ring, and a narrow spiral whose arms a coarse tolerance alone would cross."""
    t = np.linspace(0, 2 * np.pi, 100_001)
    r = 1000 + 4 * np.sin(900 * t)
    ring = np.stack([r * np.cos(t), r * np.sin(t)], axis=1)
    ring[-1] = ring[0]
    u = np.linspace(0, 60 * np.pi, 120_000)
    spiral = np.stack([(5 + u) * np.cos(u), (5 + u) * np.sin(u)], axis=1) + np.stack([np.zeros_like(u), 0.3 * np.sin(40 * u)], axis=1)
    assert not geometry._crosses(ring) and not geometry._crosses(spiral)
    lines = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in enumerate((ring, spiral))], f"k int, v {geometry.VERTICES}")
    got = {r.k: np.array([(v.x, v.y) for v in r.s]) for r in lines.select("k", geometry.simplify(6.0)("v").alias("s")).collect()}
    for k, p in enumerate((ring, spiral)):
        assert 4 <= len(got[k]) < len(p) / 20 and not geometry._crosses(got[k])
        assert (got[k][0] == p[0]).all() and (got[k][-1] == p[-1]).all()
    knot = np.concatenate([ring[:50_000], ring[10:11], ring[50_000:]])
    assert geometry._crosses(knot)
