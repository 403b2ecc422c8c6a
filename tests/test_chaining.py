"""Contours chained over blocks against a walk over all segments at once."""

import numpy as np
import pytest

from gridmetric.operators import chaining, geometry


def _walked(rows):
    """contour_id: vertices, from one dictionary of all segments of a scene."""
    after = {r.e1: r for r in rows}
    heads = set(after) - {r.e2 for r in rows}
    out, left = {}, set(after)

    def walk(edge):
        own = []
        first = edge
        while edge in after and (edge in left):
            r = after[edge]
            left.discard(edge)
            own.append(r)
            edge = r.e2
        out[first] = [(r.x1, r.y1) for r in own] + [(own[-1].x2, own[-1].y2)]

    for edge in sorted(heads):
        walk(edge)
    for edge in sorted(after):  # rings from their least edge
        if edge in left:
            walk(edge)
    return out


def _canvas(kind, size, rng):
    y, x = np.mgrid[0:size, 0:size].astype(float)
    if kind == "disc":
        return size / 3 - np.hypot(y - size / 2.2, x - size / 2.1)
    if kind == "waves":
        return np.sin(y / 2.3) + np.cos(x / 3.1) - 0.2
    return rng.normal(size=(size, size)) if kind == "noise" else rng.integers(-1, 2, (size, size)).astype(float)  # with points on the level


@pytest.mark.parametrize("block", [1, 4, 9, 512])
def test_contours_over_blocks_equal_a_walk(spark, block):
    rng = np.random.default_rng(2)
    rows = [(k, r, c, float(v)) for k, kind in enumerate(("disc", "waves", "noise", "ties")) for (r, c), v in np.ndenumerate(_canvas(kind, 23, rng))]
    segments = geometry.iso_segments(spark.createDataFrame([*rows, (None, 0, 0, 1.0)], "scene int, r int, c int, p double"), 0.0)
    every = segments.collect()
    parts = chaining.contour_parts(segments, block=block).persist()
    got = {(r.scene, r.contour_id): [tuple(v) for v in r.vertices] for r in chaining.contour_lines(parts).collect()}
    want = {(k, c): v for k in range(4) for c, v in _walked([r for r in every if r.scene == k]).items()}
    assert got == want
    sums = {(r.scene, r.contour_id): r for r in chaining.contour_lengths(parts).collect()}
    for key, line in want.items():
        length = sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(line, line[1:]))
        assert (length == 0 and key not in sums) or (abs(sums[key].length - length) < 1e-9 and sums[key].n_vertices == len(line))
    assert max(r.n for r in parts.collect()) <= 2 * block * block


def test_one_long_ring_and_nothing(spark):
    """A ring of some hundred runs is cut once, at its least edge."""
    rows = [(0, r, c, float(min(r, c, 59 - r, 59 - c) - 1.5)) for r in range(60) for c in range(60)]
    segments = geometry.iso_segments(spark.createDataFrame(rows, "scene int, r int, c int, p double"), 0.0)
    parts = chaining.contour_parts(segments, block=2).collect()
    assert len({p.contour_id for p in parts}) == 1 and sorted(p.part for p in parts) == list(range(len(parts))) and len(parts) > 100
    assert min(p.s for p in parts) == parts[0].contour_id
    assert chaining.contour_lines(chaining.contour_parts(segments.limit(0))).count() == 0


def test_chain_order_cuts_rings_at_their_least_start():
    start, end = np.array([5, 3, 9, 1, 7]), np.array([3, 9, 5, 7, 8])
    first, place = chaining.chain_order(start, end)
    assert start[first].tolist() == [3, 3, 3, 1, 1] and place.tolist() == [2, 0, 1, 0, 1]
    assert [len(x) for x in chaining.chain_order(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
