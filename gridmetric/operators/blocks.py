"""Rasters as blocks, one row a block of pixels: halos from neighbouring blocks, scoring in windows, stitching, and overlays of stored rasters.

A row has scene, by and bx (the block's place), height and width (the scene's) and arrays of the block's pixels, row by row. Blocks are square but for
those at a scene's lower and right edge. A task holds a block with its halo, whatever the size of the scene.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from gridmetric.operators.ranking import deal
from gridmetric.operators.tiles import check_views, weights_1d
from gridmetric.sources.shared import scratch_folder

PLACE = "by int, bx int, height int, width int"
PART = f"{PLACE}, y int, x int, h int, w int"


def _head(df: DataFrame, more: str) -> StructType:
    return StructType([df.schema["scene"], *StructType.fromDDL(more).fields])


def scene_sizes(pixels: DataFrame) -> DataFrame:
    """scene, height and width of rasters that begin at row and column 0."""
    return pixels.groupBy("scene").agg((F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))


def raster_blocks(pixels: DataFrame, sizes: DataFrame, size: int, *values: str, rows: int = 0) -> DataFrame:
    """Blocks of size x size pixels of each scene in sizes (scene, height, width), from pixels (scene, r, c and values); null where there is no pixel.

    All blocks of a scene are there, with or without pixels; pixels outside are left out. Of several at one place the last that comes counts.
    With rows (about the number of pixels) tasks are as many as these need, and as Spark decides without.
    """
    steps = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size).cast("int"))
    grid = sizes.select("scene", "height", "width", F.explode(steps("height")).alias("by")).select("*", F.explode(steps("width")).alias("bx"))
    here = pixels.select("scene", F.expr(f"CAST(r div {size} AS INT)").alias("by"), F.expr(f"CAST(c div {size} AS INT)").alias("bx"), F.expr(f"CAST(r % {size} AS INT)").alias("i"), F.expr(f"CAST(c % {size} AS INT)").alias("j"), *values)
    schema = StructType([*_head(grid, PLACE).fields, *[StructField(v, ArrayType(pixels.schema[v].dataType)) for v in values]])

    def fill(own: pa.Table, found: pa.Table) -> pa.Table:
        if own.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in [("scene", own.schema.field("scene").type), *[(n, pa.int32()) for n in ("by", "bx", "height", "width")]]} | {v: pa.array([], pa.list_(found.schema.field(v).type)) for v in values})
        first = own.slice(0, 1)
        by, bx, height, width = (first[n][0].as_py() for n in ("by", "bx", "height", "width"))
        h, w = min(size, height - by * size), min(size, width - bx * size)
        i, j = found["i"].to_numpy(), found["j"].to_numpy()
        inside = (i < h) & (j < w)
        at = np.full(h * w, -1, np.int64)
        at[i[inside] * w + j[inside]] = np.flatnonzero(inside)
        taken = pa.array(at, mask=at < 0)
        arrays = {v: pa.ListArray.from_arrays(pa.array([0, h * w], pa.int32()), found[v].combine_chunks().take(taken)) for v in values}
        return pa.table({n: first[n].combine_chunks() for n in ("scene", "by", "bx", "height", "width")} | arrays)

    grid, here = (deal(d, rows, "scene", "by", "bx") for d in (grid.select("scene", "by", "bx", "height", "width"), here))
    return grid.groupBy("scene", "by", "bx").cogroup(here.groupBy("scene", "by", "bx")).applyInArrow(fill, schema)


def block_pixels(blocks: DataFrame, size: int, *values: str) -> DataFrame:
    """scene, r, c and values of every pixel of the blocks."""
    w = F.least(F.lit(size), F.col("width") - F.col("bx") * size)
    if len(values) == 1:
        rows = blocks.select("scene", "by", "bx", w.alias("w"), F.posexplode(values[0]).alias("k", values[0]))
    else:
        rows = blocks.select("scene", "by", "bx", w.alias("w"), F.posexplode(F.arrays_zip(*values)).alias("k", "v")).select("scene", "by", "bx", "w", "k", "v.*")
    return rows.select("scene", (F.col("by") * size + F.expr("CAST(k div w AS INT)")).alias("r"), (F.col("bx") * size + F.col("k") % F.col("w")).cast("int").alias("c"), *values)


# Parts that blocks send each other


def _numbers(row: dict) -> tuple[int, int, int, int]:
    return row["by"], row["bx"], row["height"], row["width"]


def _targets(begin: int, stop: int, size: int, length: int, before: int, after: int) -> Iterator[tuple[int, int, int, int]]:
    """Blocks along an axis that want some of [begin, stop): number, first and last pixel of it, and where it lies in their extended block."""
    first, last = max(0, (begin - after) // size), min((length - 1) // size, (stop - 1 + before) // size)
    for k in range(first, last + 1):
        low, high = k * size - before, min(k * size + size, length) + after
        a, b = max(begin, low), min(stop, high)
        if a < b:
            yield k, a, b, a - low


def _parts(row: dict, y0: int, x0: int, arrays: list[np.ndarray], size: int, before: int, after: int) -> Iterator[tuple]:
    """The pieces of arrays that begin at (y0, x0) of the scene which other blocks, and this one, want."""
    height, width = row["height"], row["width"]
    h, w = arrays[0].shape
    for ty, a, b, y in _targets(y0, min(y0 + h, height), size, height, before, after):
        for tx, c, d, x in _targets(x0, min(x0 + w, width), size, width, before, after):
            yield (row["scene"], ty, tx, height, width, y, x, b - a, d - c, *[m[a - y0 : b - y0, c - x0 : d - x0].ravel() for m in arrays])


def _part_batch(parts: list[tuple], scene_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*parts)) if parts else [[] for _ in range(9 + len(names))]
    places = [pa.array(c, pa.int32()) for c in cols[1:9]]
    arrays = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), pa.array(np.concatenate(c) if len(c) else np.zeros(0))) for c in cols[9:]]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], scene_type), *places, *arrays], names=["scene", "by", "bx", "height", "width", "y", "x", "h", "w", *names])


def _matrix(column: pa.Array, k: int, h: int, w: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)


def _received(table: pa.Table, size: int, before: int, after: int, names: list[str], combine: Callable) -> tuple[dict, list[np.ndarray]]:
    """A block's extended arrays from the parts it was sent. combine(arrays, window, part) puts a part in its place."""
    table = table.combine_chunks()
    row = table.select(["scene", "by", "bx", "height", "width"]).slice(0, 1).to_pylist()[0]
    by, bx, height, width = _numbers(row)
    shape = (min(size, height - by * size) + before + after, min(size, width - bx * size) + before + after)
    arrays = None
    place = [table[n].to_numpy() for n in ("y", "x", "h", "w")]
    columns = [table[n].combine_chunks() for n in names]
    for k in range(table.num_rows):
        y, x, h, w = (int(p[k]) for p in place)
        arrays = combine(arrays, shape, (slice(y, y + h), slice(x, x + w)), [_matrix(c, k, h, w) for c in columns])
    return row, arrays


def with_halo(blocks: DataFrame, size: int, before: int, after: int, value: str, fill: float = 0.0) -> DataFrame:
    """Blocks extended by `before` pixels above and to the left and `after` below and to the right, from their neighbours in one exchange.

    What lies outside the scene, and null pixels, have the fill value. Halos may be wider than a block.
    """
    schema = _head(blocks, f"{PART}, part array<double>")

    def send(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(["scene", "by", "bx", "height", "width"]).to_pylist()):
                by, bx, height, width = _numbers(row)
                h, w = min(size, height - by * size), min(size, width - bx * size)
                own = _matrix(batch.column(value), k, h, w)
                yield _part_batch(list(_parts(row, by * size, bx * size, [np.where(np.isnan(own), fill, own)], size, before, after)), batch.schema.field("scene").type, ["part"])

    def paste(arrays, shape, at, part):
        arrays = [np.full(shape, fill)] if arrays is None else arrays
        arrays[0][at] = part[0]
        return arrays

    def receive(table: pa.Table) -> pa.Table:
        row, (whole,) = _received(table, size, before, after, ["part"], paste)
        place = {n: pa.array([row[n]], table.schema.field(n).type) for n in ("scene", "by", "bx", "height", "width")}
        return pa.table(place | {value: pa.array([whole.ravel()], pa.list_(pa.float64()))})

    sent = blocks.select("scene", "by", "bx", "height", "width", value).mapInArrow(send, schema)
    return sent.groupBy("scene", "by", "bx").applyInArrow(receive, _head(blocks, f"{PLACE}, {value} array<double>"))


def read_window(blocks: DataFrame, windows: DataFrame, size: int, value: str, boundless: bool = False, fill: float = 0.0) -> DataFrame:
    """Blocks of the part of each scene's raster that a window names: windows has scene, row_off, col_off, height and width, one row a scene.

    Boundless, what lies outside the raster has the fill value; else a window that isn't within its raster is an error. Null pixels stay null, as NaN.
    Scenes without a window, and windows without a raster, give nothing. A block goes to the blocks of the window that want some of it, and to no others.
    """
    inside = (F.col("row_off") >= 0) & (F.col("col_off") >= 0) & (F.col("row_off") + F.col("wh") <= F.col("height")) & (F.col("col_off") + F.col("ww") <= F.col("width"))
    message = F.concat(F.lit("the window of scene "), F.col("scene").cast("string"), F.lit(" isn't within its raster"))
    named = windows.select("scene", F.col("row_off").cast("int").alias("row_off"), F.col("col_off").cast("int").alias("col_off"), F.col("height").cast("int").alias("wh"), F.col("width").cast("int").alias("ww"))
    both = blocks.select("scene", "by", "bx", "height", "width", value).join(named, "scene")
    if not boundless:
        both = both.withColumn("row_off", F.when(inside, F.col("row_off")).otherwise(F.raise_error(message).cast("int")))
    low, left = F.col("by") * size - F.col("row_off"), F.col("bx") * size - F.col("col_off")
    wanted = both.where((low < F.col("wh")) & (low + size > 0) & (left < F.col("ww")) & (left + size > 0))
    schema = _head(blocks, f"{PART}, part array<double>")

    def send(batches):
        for batch in batches:
            for k, row in enumerate(batch.drop_columns([value]).to_pylist()):
                by, bx, height, width = _numbers(row)
                h, w = min(size, height - by * size), min(size, width - bx * size)
                y0, x0 = by * size - row["row_off"], bx * size - row["col_off"]
                own = _matrix(batch.column(value), k, h, w)[max(0, -y0) :, max(0, -x0) :]
                parts = list(_parts(row | {"height": row["wh"], "width": row["ww"]}, max(0, y0), max(0, x0), [own], size, 0, 0)) if own.size else []
                yield _part_batch(parts, batch.schema.field("scene").type, ["part"])

    def paste(arrays, shape, at, part):
        arrays = [np.full(shape, fill)] if arrays is None else arrays
        arrays[0][at] = part[0]
        return arrays

    def receive(table: pa.Table) -> pa.Table:
        row, (whole,) = _received(table, size, 0, 0, ["part"], paste)
        place = {n: pa.array([row[n]], table.schema.field(n).type) for n in ("scene", "by", "bx", "height", "width")}
        return pa.table(place | {value: pa.array([whole.ravel()], pa.list_(pa.float64()))})

    # An empty part for each block of a window, so that blocks outside the raster are there too.
    steps = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size).cast("int"))
    there = named.join(blocks.select("scene").distinct(), "scene", "left_semi")
    grid = there.select("scene", "wh", "ww", F.explode(steps("wh")).alias("by")).select("*", F.explode(steps("ww")).alias("bx"))
    zero = [F.lit(0).alias(n) for n in ("y", "x", "h", "w")]
    empty = grid.select("scene", "by", "bx", F.col("wh").alias("height"), F.col("ww").alias("width"), *zero, F.array().cast("array<double>").alias("part"))
    return wanted.mapInArrow(send, schema).unionByName(empty).groupBy("scene", "by", "bx").applyInArrow(receive, _head(blocks, f"{PLACE}, {value} array<double>"))


def axis_windows(length: int, tile: int, stride: int, policy: str = "shift_inward") -> list[int]:
    """Starts of windows along an axis, as tiles.axis_starts has them."""
    if length <= tile:
        return [0]
    if policy == "allow_sliver":
        return list(range(0, length, stride))
    if policy != "shift_inward":
        raise ValueError(f"unknown edge policy {policy!r}")
    return sorted({*range(0, length - tile + 1, stride), length - tile})


def _scored(crops: np.ndarray, scorer: Callable[[np.ndarray], np.ndarray], views: list[str]) -> np.ndarray:
    """Mean over flipped views of the scores, flipped back."""
    total = 0.0
    for view in views:
        axes = [1] * (view in ("vflip", "hvflip")) + [2] * (view in ("hflip", "hvflip"))
        total = total + np.flip(np.asarray(scorer(np.ascontiguousarray(np.flip(crops, axes))), float), axes)
    return total / len(views)


def scene_inference(
    blocks: DataFrame, size: int, tile: int, scorer: Callable[[np.ndarray], np.ndarray], stride: int | None = None, buffer: int = 0, value: str = "p", policy: str = "shift_inward",
    views: tuple[str, ...] = ("identity",), mode: str = "weighted_blend", window: str = "hann", least: float = 1e-3, fill: float = 0.0, batch: int = 64,
) -> DataFrame:
    """The blocks with the stitched score of each pixel in place of its value.

    Windows of tile x tile pixels lie on each scene at the given stride. Each is read with `buffer` pixels around it (fill outside the scene and where
    pixels are null), scored as it is and in its flipped views, and cropped. Where windows overlap, weighted_blend takes the mean by weights that taper
    to their edges, and crop_only the window of the greatest number, row by row. A pixel that no window covers is an error.

    scorer: a function from an array of windows (n, tile + 2 buffer, tile + 2 buffer) to one of scores of that shape. A window is scored once, by the
    block in which it begins, `batch` windows at a time. There are two exchanges: of halos, and of what windows give to neighbouring blocks.
    """
    stride = tile if stride is None else stride
    views = check_views(list(views))
    if stride <= 0 or buffer < 0:
        raise ValueError("stride must be positive and buffer not negative")
    if mode not in ("weighted_blend", "crop_only"):
        raise ValueError(f"unknown mode {mode!r}")
    blend = mode == "weighted_blend"
    weights_1d(2, window, least)  # for its errors
    before, after = buffer, buffer + tile - 1
    extended = with_halo(blocks, size, before, after, value, fill)

    def score(batches):
        for b in batches:
            for number, row in enumerate(b.select(["scene", "by", "bx", "height", "width"]).to_pylist()):
                by, bx, height, width = _numbers(row)
                y0, x0, h, w = by * size, bx * size, min(size, height - by * size), min(size, width - bx * size)
                source = _matrix(b.column(value), number, h + before + after, w + before + after)
                rows, cols = axis_windows(height, tile, stride, policy), axis_windows(width, tile, stride, policy)
                own = [(iy * len(cols) + ix, y, x) for iy, y in enumerate(rows) if y0 <= y < y0 + h for ix, x in enumerate(cols) if x0 <= x < x0 + w]
                # What is summed up, and the weights; or values, and the numbers of their windows from 1.
                sums, weights = np.zeros((h + tile - 1, w + tile - 1)), np.zeros((h + tile - 1, w + tile - 1))
                side = tile + 2 * buffer
                for k in range(0, len(own), batch):
                    some = own[k : k + batch]
                    crops = np.stack([source[y - y0 : y - y0 + side, x - x0 : x - x0 + side] for _, y, x in some])
                    for (nth, y, x), p in zip(some, _scored(crops, scorer, views)):
                        vh, vw = min(tile, height - y), min(tile, width - x)
                        at, inner = (slice(y - y0, y - y0 + vh), slice(x - x0, x - x0 + vw)), p[buffer : buffer + vh, buffer : buffer + vw]
                        if blend:
                            weight = np.outer(weights_1d(vh, window, least), weights_1d(vw, window, least))
                            sums[at] += inner * weight
                            weights[at] += weight
                        else:
                            sums[at], weights[at] = inner, nth + 1
                yield _part_batch(list(_parts(row, y0, x0, [sums, weights], size, 0, 0)), b.schema.field("scene").type, ["sums", "weights"])

    def add(arrays, shape, at, part):
        arrays = [np.zeros(shape), np.zeros(shape)] if arrays is None else arrays
        if blend:
            arrays[0][at] += part[0]
            arrays[1][at] += part[1]
        else:
            later = part[1] > arrays[1][at]
            arrays[0][at], arrays[1][at] = np.where(later, part[0], arrays[0][at]), np.where(later, part[1], arrays[1][at])
        return arrays

    def receive(table: pa.Table) -> pa.Table:
        row, (sums, weights) = _received(table.sort_by([("y", "ascending"), ("x", "ascending"), ("h", "ascending"), ("w", "ascending")]), size, 0, 0, ["sums", "weights"], add)
        if (weights == 0).any():
            raise ValueError(f"{int((weights == 0).sum())} pixels without coverage in block {row['by']}, {row['bx']} of scene {row['scene']}")
        place = {n: pa.array([row[n]], table.schema.field(n).type) for n in ("scene", "by", "bx", "height", "width")}
        return pa.table(place | {value: pa.array([(sums / weights if blend else sums).ravel()], pa.list_(pa.float64()))})

    given = extended.mapInArrow(score, _head(blocks, f"{PART}, sums array<double>, weights array<double>"))
    return given.groupBy("scene", "by", "bx").applyInArrow(receive, _head(blocks, f"{PLACE}, {value} array<double>"))


# Stored rasters


def store_blocks(blocks: DataFrame, buckets: int, name: str | None = None) -> DataFrame:
    """Writes blocks as a table in the shared folder, bucketed and sorted by scene and block, and reads it.

    Rasters stored with one number of buckets and one size of blocks meet without an exchange. Each task writes one bucket.
    """
    spark, name = blocks.sparkSession, name or f"blocks_{uuid.uuid4().hex[:12]}"
    keys = ["scene", "by", "bx"]
    dealt = blocks.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", scratch_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def overlay_blocks(reference: DataFrame, prediction: DataFrame, size: int, mask: DataFrame | None = None, values=("ref", "p"), mask_value: str = "msk", boundless: bool = False) -> DataFrame:
    """scene, r, c and values of pixels that the reference and the prediction have; with a mask its value, which is 0 where it has none if boundless,
    and else such pixels go.

    Blocks meet as rows, and pixels by their place in the arrays. The sides are merged in the order in which stored rasters lie.
    """
    keys = ["scene", "by", "bx"]
    a, b = values
    both = reference.select(*keys, "width", a).hint("merge").join(prediction.select(*keys, b), keys)
    wanted = [a, b]
    if mask is not None:
        both = both.join(mask.select(*keys, mask_value).hint("merge"), keys, "left" if boundless else "inner")
        wanted.append(mask_value)
    out = block_pixels(both, size, *wanted).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if mask is None:
        return out
    return out.withColumn(mask_value, F.coalesce(mask_value, F.lit(0))) if boundless else out.where(F.col(mask_value).isNotNull())
