"""Tile grids, blend weights, flips and stitching as relations of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmetric.functions.scalar import sigmoid


def axis_starts(length: Column, crop: int, stride: int, policy: str = "shift_inward") -> Column:
    """Array of window starts along an axis: 0 alone if the crop covers it; slivers allowed, or the last window moved inward."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    if policy == "allow_sliver":
        starts = F.sequence(F.lit(0), length - 1, F.lit(stride))
    elif policy == "shift_inward":
        starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(length - crop, F.lit(0)), F.lit(stride)), F.array(F.greatest(length - crop, F.lit(0))))))
    else:
        raise ValueError(f"unknown edge policy {policy!r}")
    return F.when(length <= crop, F.array(F.lit(0))).otherwise(starts)


def tile_grid(scenes: DataFrame, tile: int, stride: int | None = None, buffer: int = 0, policy: str = "shift_inward") -> DataFrame:
    """scene, tile_id (row-major), valid_y0, valid_x0, valid_h, valid_w, origin_y, origin_x of every window over scenes (scene, height, width)."""
    stride = tile if stride is None else stride
    if stride > tile:
        raise ValueError("stride must not exceed the tile size")
    if buffer < 0:
        raise ValueError("buffer must not be negative")
    ys, xs = axis_starts(F.col("height"), tile, stride, policy), axis_starts(F.col("width"), tile, stride, policy)
    g = scenes.select("scene", "height", "width", F.size(xs).alias("nx"), xs.alias("xs"), F.posexplode(ys).alias("iy", "valid_y0")).select("*", F.posexplode("xs").alias("ix", "valid_x0"))
    return g.select("scene", (F.col("iy") * F.col("nx") + F.col("ix")).alias("tile_id"), "valid_y0", "valid_x0", F.least(F.lit(tile), F.col("height") - F.col("valid_y0")).alias("valid_h"),
                    F.least(F.lit(tile), F.col("width") - F.col("valid_x0")).alias("valid_w"), (F.col("valid_y0") - buffer).alias("origin_y"), (F.col("valid_x0") - buffer).alias("origin_x"))


def boundless_read(pixels: DataFrame, cells: DataFrame, bands: dict[str, float], on=("scene", "r", "c")) -> DataFrame:
    """Bands at the wanted cells, with each band's fill value outside the raster."""
    return cells.join(pixels, list(on), "left").select(*on, *(F.coalesce(F.col(b), F.lit(v)).alias(b) for b, v in bands.items()))


def tile_pixels(tiles: DataFrame, size: int, values: str = "values") -> DataFrame:
    """One row a pixel: tile_id, other columns, i and j (row and column within the tile) and v."""
    rest = [c for c in tiles.columns if c != values]
    return tiles.select(*rest, F.posexplode(values).alias("_k", "v")).select(*rest, F.expr(f"CAST(_k div {size} AS INT)").alias("i"), (F.col("_k") % size).cast("int").alias("j"), "v")


def interior(pixels: DataFrame, buffer: int, height: int, width: int) -> DataFrame:
    """Pixels inside a buffer, counted from its inner corner."""
    inside = pixels.where(F.col("i").between(buffer, buffer + height - 1) & F.col("j").between(buffer, buffer + width - 1))
    return inside.withColumn("i", F.col("i") - buffer).withColumn("j", F.col("j") - buffer)


# Views


VIEWS = ("identity", "hflip", "vflip", "hvflip")


def check_views(names: list[str]) -> list[str]:
    """Known names in order, each once; none or an unknown one is an error."""
    out = list(dict.fromkeys(names))
    if not out or any(n not in VIEWS for n in out):
        raise ValueError(f"views must be some of {VIEWS}")
    return out


def flip(pixels: DataFrame, view: str, height: int, width: int) -> DataFrame:
    """The pixels of a flipped tile; every view is its own inverse."""
    if view in ("hflip", "hvflip"):
        pixels = pixels.withColumn("j", width - 1 - F.col("j"))
    if view in ("vflip", "hvflip"):
        pixels = pixels.withColumn("i", height - 1 - F.col("i"))
    return pixels


def flip_array(values: str, view: str, height: int, width: int) -> Column:
    """The same on a row-major array column, by index arithmetic."""
    if view not in VIEWS:
        raise ValueError(f"views must be some of {VIEWS}")
    at = lambda k: F.expr(f"CAST({k} AS INT)")
    rows, cols = view in ("vflip", "hvflip"), view in ("hflip", "hvflip")

    def source(k: Column) -> Column:
        i, j = F.floor(k / width).cast("int"), (k % width).cast("int")
        return (height - 1 - i if rows else i) * width + (width - 1 - j if cols else j)

    return F.transform(F.sequence(at(0), at(height * width - 1)), lambda k: F.get(values, source(k)))


def tta_mean(pixels: DataFrame, names: list[str], height: int, width: int, score=lambda v, i, j: sigmoid(v)) -> DataFrame:
    """tile_id, i, j, p: the mean over views of the score of the flipped tile, flipped back. A pixel has all its views itself: nothing is shuffled."""
    views = check_views(names)
    scores = []
    for view in views:
        i = height - 1 - F.col("i") if view in ("vflip", "hvflip") else F.col("i")
        j = width - 1 - F.col("j") if view in ("hflip", "hvflip") else F.col("j")
        scores.append(score(F.col("v"), i, j))
    return pixels.select("tile_id", "i", "j", (sum(scores[1:], scores[0]) / len(scores)).alias("p"))


#: Multipliers of the generator of random views, one a draw, and its modulus.
DRAWS, MODULUS = (48271, 69621, 39373, 16807), 2_147_483_647


def _draw(k: int, seed: int) -> Column:
    """A whole number below MODULUS for each tile: arithmetic that is alike in every engine."""
    start = F.pmod(F.col("tile_id"), F.lit(MODULUS)) * 7919 + (seed + k) * 104_729
    once = F.pmod(F.pmod(start, F.lit(MODULUS)) * DRAWS[k], F.lit(MODULUS))
    return F.pmod((once.bitwiseXOR(F.shiftright(once, 13))) * DRAWS[k], F.lit(MODULUS))


def random_augment(tiles: DataFrame, arrays: list[str], size: int, p: float = 0.5, seed: int = 42) -> DataFrame:
    """Square tiles flipped or turned at random, all arrays of a row alike. A row's draws are hashes of tile_id, so they repeat."""
    cut, n = int(p * MODULUS), size - 1
    turns = F.when(_draw(2, seed) < cut, F.pmod(_draw(3, seed), F.lit(3)) + 1).otherwise(0)
    x = tiles.withColumn("hflip", _draw(0, seed) < cut).withColumn("vflip", _draw(1, seed) < cut).withColumn("turns", turns.cast("int"))

    def source(k: Column) -> Column:
        """Place in the given tile of place k of the new one: turned first, then flipped."""
        i, j, t = F.floor(k / size).cast("int"), (k % size).cast("int"), F.col("turns")
        si = F.when(t == 1, j).when(t == 2, n - i).when(t == 3, n - j).otherwise(i)
        sj = F.when(t == 1, n - i).when(t == 2, n - j).when(t == 3, i).otherwise(j)
        return F.when(F.col("vflip"), n - si).otherwise(si) * size + F.when(F.col("hflip"), n - sj).otherwise(sj)

    def moved(array: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.get(array, source(k)))

    return x.withColumns({a: moved(a) for a in arrays})


# Stitching


def weights_1d(n: int, window: str = "hann", least: float = 0.05) -> list[float]:
    """Blend weights along an axis: constant, hann or linear, no less than `least`, the largest 1."""
    if not 0 < least <= 1:
        raise ValueError("the least weight must lie in (0, 1]")
    if window == "constant" or n == 1:
        w = [1.0] * n
    elif window == "hann":
        w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    elif window == "linear":
        w = [1 - abs((i - (n - 1) / 2) / ((n - 1) / 2)) for i in range(n)]
    else:
        raise ValueError(f"unknown window {window!r}")
    w = [max(x, least) for x in w]
    return [x / max(w) for x in w]


def weight(row: str, col: str, height: int, width: int, window: str = "hann", least: float = 0.05) -> Column:
    """Outer product of both axes' weights at a pixel, from literal arrays: no join."""
    y, x = (F.array(*map(F.lit, weights_1d(n, window, least))) for n in (height, width))
    return F.get(y, F.col(row)) * F.get(x, F.col(col))


def stitch_weighted(pixels: DataFrame, size: int, window: str = "hann", least: float = 0.05, keys=(), value: str = "v") -> DataFrame:
    """keys, r, c, p: weighted mean of overlapping tiles (y0, x0, i, j). The only shuffle is that of the sums."""
    x = pixels.select(*keys, (F.col("y0") + F.col("i")).alias("r"), (F.col("x0") + F.col("j")).alias("c"), F.col(value).cast("double").alias("v"), weight("i", "j", size, size, window, least).alias("w"))
    return x.groupBy(*keys, "r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("p"))


def naive_stitch(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    """The weighted mean by joining pixels with a table of weights and dividing in a window over each cell. For comparison only."""
    spark, w = pixels.sparkSession, weights_1d(size)
    table = spark.createDataFrame([(i, j, w[i] * w[j]) for i in range(size) for j in range(size)], "i int, j int, w double")
    x = pixels.join(table, ["i", "j"]).select((F.col("y0") + F.col("i")).alias("r"), (F.col("x0") + F.col("j")).alias("c"), F.col(value).cast("double").alias("v"), "w")
    total = F.sum("w").over(Window.partitionBy("r", "c"))
    return x.withColumn("share", F.col("w") / total).groupBy("r", "c").agg(F.sum(F.col("v") * F.col("share")).alias("p"))


def stitch_crop_only(pixels: DataFrame, keys=(), value: str = "v") -> DataFrame:
    """keys, r, c, p: the tile of the greatest number wins."""
    x = pixels.select(*keys, (F.col("y0") + F.col("i")).alias("r"), (F.col("x0") + F.col("j")).alias("c"), F.struct("tile_id", F.col(value).alias("v")).alias("s"))
    return x.groupBy(*keys, "r", "c").agg(F.max("s").alias("s")).select(*keys, "r", "c", F.col("s.v").alias("p"))


def coverage_gaps(stitched: DataFrame, height: int, width: int) -> DataFrame:
    """r, c of cells that no tile covers."""
    full = stitched.sparkSession.range(height * width).select(F.expr(f"CAST(id div {width} AS INT)").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return full.join(stitched.select("r", "c"), ["r", "c"], "left_anti")


def require_coverage(stitched: DataFrame, height: int, width: int) -> DataFrame:
    n = coverage_gaps(stitched, height, width).count()
    if n:
        raise ValueError(f"missing coverage: {n} pixels")
    return stitched


def score_tiles(tiles: DataFrame, scorer, values: str = "values") -> DataFrame:
    """tile_id and scores (array) by a scorer from a numpy matrix of tiles to one of scores, a batch at a time."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"tile_id": f["tile_id"], "scores": list(np.asarray(scorer(np.stack(f[values].to_numpy())), dtype=float))})

    return tiles.select("tile_id", values).mapInPandas(run, "tile_id long, scores array<double>")
