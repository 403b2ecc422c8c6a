"""Rasters as blocks: halos, inference over windows and overlays, against numpy on the whole raster."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from gridmetric.operators import blocks


def _pixels(spark, rasters):
    rows = [(k, r, c, float(v)) for k, a in rasters.items() for (r, c), v in np.ndenumerate(a) if not np.isnan(v)]
    return spark.createDataFrame(rows, "scene int, r int, c int, p double")


def _grid(spark, rasters, size):
    sizes = spark.createDataFrame([(k, *a.shape) for k, a in rasters.items()], "scene int, height int, width int")
    return blocks.raster_blocks(_pixels(spark, rasters), sizes, size, "p")


def _whole(rows, shape, key=0):
    out = np.full(shape, np.nan)
    for r in rows:
        if r.scene == key:
            out[r.r, r.c] = np.nan if r.p is None else r.p
    return out


def _made():
    def slope(crops):
        """A scorer that isn't symmetric: a pixel less what stands right below it, twice what stands to its left."""
        n = np.pad(crops, ((0, 0), (1, 1), (1, 1)))
        return crops - n[:, 2:, 1:-1] + 2 * n[:, 1:-1, :-2]

    return slope  # a local function goes to the workers by value


_slope = _made()


def _direct(a, views):
    filled = np.where(np.isnan(a), 0.0, a)[None]
    return blocks._scored(np.pad(filled, ((0, 0), (1, 1), (1, 1))), _slope, views)[0, 1:-1, 1:-1]


@pytest.mark.parametrize("size,tile,stride,buffer,mode", [(8, 6, 4, 1, "weighted_blend"), (5, 8, 3, 2, "weighted_blend"), (64, 8, 8, 1, "weighted_blend"), (7, 6, 3, 1, "crop_only"), (3, 10, 10, 3, "crop_only")])
def test_windows_over_blocks_see_the_whole_scene(spark, size, tile, stride, buffer, mode):
    rng = np.random.default_rng(1)
    rasters = {0: rng.normal(size=(23, 17)), 1: rng.normal(size=(4, 5)), 2: rng.normal(size=(9, 30))}
    rasters[0][5:12, 3:9] = np.nan
    views = ["identity", "hflip", "vflip"]
    grid = _grid(spark, rasters, size)
    for policy in ("shift_inward", "allow_sliver"):
        got = blocks.block_pixels(blocks.scene_inference(grid, size, tile, _slope, stride, buffer, views=views, mode=mode, policy=policy), size, "p").collect()
        for k, a in rasters.items():
            np.testing.assert_allclose(_whole(got, a.shape, k), _direct(a, views), atol=1e-9)


def test_blend_of_two_windows_and_the_later_one(spark):
    """Windows of 0.25 and 0.75 that overlap in two columns: their mean there, or the later of them."""
    grid = _grid(spark, {0: np.arange(24.0).reshape(4, 6)}, 3)
    scorer = lambda crops: np.where(crops[:, :1, :1] == 0, 0.25, 0.75) + 0 * crops
    for mode, row in (("weighted_blend", [0.25, 0.25, 0.5, 0.5, 0.75, 0.75]), ("crop_only", [0.25, 0.25, 0.75, 0.75, 0.75, 0.75])):
        got = blocks.block_pixels(blocks.scene_inference(grid, 3, 4, scorer, stride=2, mode=mode, window="constant"), 3, "p").collect()
        np.testing.assert_allclose(_whole(got, (4, 6)), np.tile(row, (4, 1)))


def test_taper_weights_are_those_of_the_valid_crop(spark):
    grid = _grid(spark, {0: np.arange(42.0).reshape(6, 7)}, 4)
    scorer = lambda crops: crops[:, :1, :1] + 0 * crops  # noqa: E731  a constant a window, so that weights show
    got = _whole(blocks.block_pixels(blocks.scene_inference(grid, 4, 4, scorer, stride=3, policy="allow_sliver", least=0.1), 4, "p").collect(), (6, 7))
    total, weight = np.zeros((6, 7)), np.zeros((6, 7))
    for y in range(0, 6, 3):
        for x in range(0, 7, 3):
            h, w = min(4, 6 - y), min(4, 7 - x)
            own = np.outer(blocks.weights_1d(h, "hann", 0.1), blocks.weights_1d(w, "hann", 0.1))
            total[y : y + h, x : x + w] += own * (7 * y + x)
            weight[y : y + h, x : x + w] += own
    np.testing.assert_allclose(got, total / weight)


def test_uncovered_pixels_and_wrong_arguments_are_errors(spark):
    grid = _grid(spark, {0: np.zeros((4, 10))}, 4)
    with pytest.raises(PythonException, match="without coverage"):
        blocks.scene_inference(grid, 4, 4, _slope, stride=5, policy="allow_sliver").collect()
    for bad in ({"stride": 0}, {"buffer": -1}, {"mode": "x"}, {"views": ("turn",)}, {"least": 0.0}, {"window": "x"}):
        with pytest.raises(ValueError):
            blocks.scene_inference(grid, 4, 4, _slope, **bad)


def test_views_of_an_even_scorer_agree(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(5, 7))
    grid = _grid(spark, {0: a}, 4)
    for views in (("identity",), ("identity", "hflip", "vflip", "hvflip")):
        got = blocks.block_pixels(blocks.scene_inference(grid, 4, 3, lambda m: 1 / (1 + np.exp(-m)), views=views), 4, "p").collect()
        np.testing.assert_allclose(_whole(got, a.shape), 1 / (1 + np.exp(-a)), atol=1e-9)


def test_blocks_and_back(spark):
    rasters = {0: np.arange(35.0).reshape(5, 7), 3: np.full((2, 2), np.nan)}
    rasters[0][1, 2] = np.nan
    grid = _grid(spark, rasters, 3).persist()
    assert grid.count() == 6 + 1 and max(len(r.p) for r in grid.collect()) == 9
    back = blocks.block_pixels(grid, 3, "p").collect()
    assert len(back) == 35 + 4
    for k, a in rasters.items():
        np.testing.assert_array_equal(_whole(back, a.shape, k), a)
    halo = {(r.by, r.bx): np.array(r.p) for r in blocks.with_halo(grid.where("scene = 0"), 3, 1, 2, "p", -1.0).collect()}
    padded = np.pad(np.where(np.isnan(rasters[0]), -1, rasters[0]), ((1, 2), (1, 2)), constant_values=-1)
    for (by, bx), v in halo.items():
        h, w = min(3, 5 - 3 * by) + 3, min(3, 7 - 3 * bx) + 3
        np.testing.assert_array_equal(v.reshape(h, w), padded[3 * by : 3 * by + h, 3 * bx : 3 * bx + w])


def test_stored_rasters_meet_without_an_exchange(spark):
    rng = np.random.default_rng(3)
    hole = lambda a, share: np.where(rng.random(a.shape) < share, np.nan, a)
    base = {k: rng.integers(0, 9, (11, 13)).astype(float) for k in range(4)}
    names = ("ref", "p", "msk")
    rasters = {n: {k: hole(a, 0.2) for k, a in base.items()} for n in names}
    stored = {n: blocks.store_blocks(_grid(spark, rasters[n], 4).withColumnRenamed("p", n), 5) for n in names}
    for mask, boundless in ((None, False), (stored["msk"], False), (stored["msk"], True)):
        out = blocks.overlay_blocks(stored["ref"], stored["p"], 4, mask, boundless=boundless)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.scene, r.r, r.c): tuple(r)[3:] for r in out.collect()}
        want = {}
        for k in base:
            for at in np.ndindex(11, 13):
                a, b, m = (float(rasters[n][k][at]) for n in names)
                if np.isnan(a) or np.isnan(b) or (mask is not None and np.isnan(m) and not boundless):
                    continue
                want[k, at[0], at[1]] = (a, b) if mask is None else (a, b, 0.0 if np.isnan(m) else m)
        assert got == want


def test_windows_of_another_raster(spark):
    a = np.arange(77.0).reshape(7, 11)
    a[2, 3] = np.nan
    grid = _grid(spark, {0: a, 1: a + 100}, 4)
    window = lambda *rows: spark.createDataFrame(list(rows), "scene int, row_off int, col_off int, height int, width int")
    read = lambda w, **o: blocks.block_pixels(blocks.read_window(grid, w, 4, "p", **o), 4, "p").collect()
    got = read(window((0, 1, 2, 5, 7), (1, 3, 0, 2, 11), (5, 0, 0, 2, 2)))
    np.testing.assert_array_equal(_whole(got, (5, 7)), a[1:6, 2:9])
    np.testing.assert_array_equal(_whole(got, (2, 11), 1), a[3:5] + 100)
    assert {r.scene for r in got} == {0, 1}
    for row, col, h, w in ((-2, -3, 12, 17), (5, 9, 6, 6), (-9, 0, 5, 5), (20, 20, 3, 9)):
        far = np.full((60, 60), -1.0)
        far[20:27, 20:31] = a
        got = read(window((0, row, col, h, w)), boundless=True, fill=-1.0)
        np.testing.assert_array_equal(_whole(got, (h, w)), far[20 + row : 20 + row + h, 20 + col : 20 + col + w])
    with pytest.raises(Exception, match="isn't within its raster"):
        read(window((0, 5, 0, 5, 5)))
