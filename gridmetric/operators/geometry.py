"""Contours as arrays of vertices: lengths, densifying, simplifying, iso-lines of a probability canvas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERTICES = "array<struct<x: double, y: double>>"


def line_length(vertices: str, scale_x: float = 1.0, scale_y: float = 1.0) -> Column:
    v = F.col(vertices)
    seg = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.hypot((b["x"] - a["x"]) * scale_x, (b["y"] - a["y"]) * scale_y))
    return F.aggregate(seg, F.lit(0.0), lambda s, x: s + x)


def valid_lines(contours: DataFrame) -> DataFrame:
    """Lines of two points or more with a length, with length and n_vertices."""
    out = contours.withColumn("length", F.round(line_length("vertices"), 9)).withColumn("n_vertices", F.size("vertices"))
    return out.where((F.col("n_vertices") >= 2) & (F.col("length") > 0))


def densify(vertices: str, spacing: float) -> Column:
    """Points added so that no part of a line is longer than the spacing."""
    v = F.col(vertices)
    parts = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: _split(a, b, spacing))
    return F.concat(F.flatten(parts), F.slice(v, -1, 1))


def _split(a: Column, b: Column, spacing: float) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / spacing).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["x"] + (b["x"] - a["x"]) * k / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / n).alias("y")))


def _douglas_peucker(p: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        n = np.hypot(*d)
        if n:
            t = np.clip((q @ d) / (n * n), 0, 1)
            dist = np.hypot(*(q - t[:, None] * d).T)
        else:
            dist = np.hypot(*q.T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


def _boxes(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper corners of the boxes around 1, 2, 4, ... consecutive parts of a line, a level each."""
    levels = [(np.minimum(p[:-1], p[1:]), np.maximum(p[:-1], p[1:]))]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        odd = len(low) % 2
        low, high = (np.concatenate([x, x[-1:]]) if odd else x for x in (low, high))
        levels.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    return levels


def _meeting(p: np.ndarray, chunk: int = 1 << 17):
    """Pairs i, j of parts of a line whose boxes touch, i + 1 < j, in bounded portions.

    Boxes of boxes of consecutive parts are followed down as long as they touch, so that a line that stays off itself costs n log n.
    """
    levels = _boxes(p)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(level, i[chunk:], j[chunk:]), (level, i[:chunk], j[:chunk])]
            continue
        if level == 0:
            apart = j > i + 1
            if apart.any():
                yield i[apart], j[apart]
            continue
        low, high = levels[level - 1]
        i, j = (np.concatenate([2 * i + a for a in (0, 0, 1, 1)]), np.concatenate([2 * j + b for b in (0, 1, 0, 1)]))
        there = (i <= j) & (j < len(low))
        i, j = i[there], j[there]
        touch = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
        if touch.any():
            stack.append((level - 1, i[touch], j[touch]))


def _crosses(p: np.ndarray) -> bool:
    """Whether two parts of the line that aren't neighbours touch or cross; in a ring the first and the last part are neighbours."""
    a, b = p[:-1], p[1:]
    ring = bool((p[0] == p[-1]).all())
    side = lambda o, d, q: np.sign((d[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (d[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0]))
    for i, j in _meeting(p):
        s1, s2, s3, s4 = side(a[i], b[i], a[j]), side(a[i], b[i], b[j]), side(a[j], b[j], a[i]), side(a[j], b[j], b[i])
        over = (s1 * s2 <= 0) & (s3 * s4 <= 0) & ((s1 != 0) | (s2 != 0) | (s3 != 0) | (s4 != 0))
        if ring:
            over &= ~((i == 0) & (j == len(a) - 1))
        if over.any():
            return True
    return False


def _simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The simplified line. A ring stays closed, with four points or more, and a line that doesn't cross itself still doesn't: the tolerance is halved
    until that holds."""
    ring = len(p) > 3 and bool((p[0] == p[-1]).all())
    clean = not _crosses(p)
    for _ in range(12):
        if ring:
            far = int(np.hypot(*(p - p[0]).T).argmax())
            q = np.concatenate([_douglas_peucker(p[: far + 1], tolerance), _douglas_peucker(p[far:], tolerance)[1:]])
        else:
            q = _douglas_peucker(p, tolerance)
        if (not ring or len(q) >= 4) and not (clean and len(q) > 3 and _crosses(q)):
            return q
        tolerance /= 2
    return p


def simplify(tolerance: float):
    """Douglas-Peucker as a pandas function from vertices to vertices, keeping rings closed and lines of any length free of new crossings."""

    @F.pandas_udf(VERTICES)
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            p = np.array([(v["x"], v["y"]) for v in line]) if line is not None and len(line) else np.zeros((0, 2))
            q = _simplified(p, tolerance) if len(p) > 2 else p
            out.append([{"x": float(x), "y": float(y)} for x, y in q])
        return pd.Series(out)

    return run


def batch_status(scenes: DataFrame, done: DataFrame, on: str = "scene", overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Scenes with what an extraction does with each: skip it where its output is there, extract it otherwise, or only say so."""
    found = scenes.join(done.select(on, F.lit(True).alias("_done")).distinct(), on, "left")
    todo = F.lit("would_extract" if dry_run else "extract")
    return found.withColumn("action", F.when(F.col("_done").isNotNull() & F.lit(not overwrite), "skip").otherwise(todo)).drop("_done")


def top_k_longest(contours: DataFrame, by, k: int, metric: str = "length") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(metric), "contour_id")
    return contours.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metric_length(geographic: Column, mean_lat: Column, vertices: str = "vertices") -> Column:
    """Length in metres: degrees by the local scale, projected units as they are; null where the latitude is missing."""
    from gridmetric.functions.scalar import meters_per_degree

    lon, lat = meters_per_degree(mean_lat)
    v = F.col(vertices)
    sx, sy = F.when(geographic, lon).otherwise(1.0), F.when(geographic, lat).otherwise(1.0)
    return F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.hypot((b["x"] - a["x"]) * sx, (b["y"] - a["y"]) * sy)), F.lit(0.0), lambda s, x: s + x)


def edges(r: Column, c: Column) -> dict[str, Column]:
    """Numbers of a cell's grid edges; neighbouring cells have the same number for the one they share."""
    number = lambda y, x: y.cast("long") * (1 << 32) + x
    return {"top": number(2 * r, 2 * c + 1), "left": number(2 * r + 1, 2 * c), "bottom": number(2 * r + 2, 2 * c + 1), "right": number(2 * r + 1, 2 * c + 2)}


def iso_segments(pixels: DataFrame, level: float, keys=("scene",), value: str = "p") -> DataFrame:
    """keys, r, c, e1, e2, x1, y1, x2, y2: marching-squares segments of each cell (r, c) of four neighbouring pixels, from grid edge e1 to e2.

    A cell needs its right, lower and diagonal neighbour, which windows along rows and columns give: canvases are never whole in one task's memory.
    Saddles are cut by the mean of the four values. All segments have the high side to their left, so that each grid edge begins one segment at most.
    """
    here = pixels.select(*keys, "r", "c", F.col(value).cast("double").alias("a"))
    right = Window.partitionBy(*keys, "r").orderBy("c")
    rows = here.withColumn("b", F.when(F.lead("c").over(right) == F.col("c") + 1, F.lead("a").over(right)))
    down = Window.partitionBy(*keys, "c").orderBy("r")
    below = F.lead("r").over(down) == F.col("r") + 1
    cell = rows.withColumn("d", F.when(below, F.lead("a").over(down))).withColumn("e", F.when(below, F.lead("b").over(down)))
    cell = cell.where(F.col("b").isNotNull() & F.col("d").isNotNull() & F.col("e").isNotNull())
    t = lambda p, q: (F.lit(level) - F.col(p)) / (F.col(q) - F.col(p))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    e = edges(F.col("r"), F.col("c"))
    point = lambda x, y, edge: F.struct(x.alias("x"), y.alias("y"), e[edge].alias("e"))
    top, left = point(c + t("a", "b"), r, "top"), point(c, r + t("a", "d"), "left")
    bottom, side = point(c + t("d", "e"), r + 1, "bottom"), point(c + 1, r + t("b", "e"), "right")
    code = sum((F.when(F.col(n) > level, v).otherwise(0) for n, v in (("a", 1), ("b", 2), ("e", 4), ("d", 8))), F.lit(0))
    high = (F.col("a") + F.col("b") + F.col("d") + F.col("e")) / 4 > level
    seg = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    cases = {1: [seg(left, top)], 2: [seg(top, side)], 3: [seg(left, side)], 4: [seg(side, bottom)], 6: [seg(top, bottom)], 7: [seg(left, bottom)], 8: [seg(bottom, left)], 9: [seg(bottom, top)], 11: [seg(bottom, side)], 12: [seg(side, left)], 13: [seg(side, top)], 14: [seg(top, left)]}
    lines = None
    for k, s in cases.items():
        lines = F.when(F.col("code") == k, F.array(*s)) if lines is None else lines.when(F.col("code") == k, F.array(*s))
    lines = lines.when((F.col("code") == 5) & F.col("high"), F.array(seg(left, bottom), seg(side, top))).when(F.col("code") == 5, F.array(seg(left, top), seg(side, bottom)))
    lines = lines.when((F.col("code") == 10) & F.col("high"), F.array(seg(top, left), seg(bottom, side))).when(F.col("code") == 10, F.array(seg(top, side), seg(bottom, left)))
    out = cell.withColumn("code", code).withColumn("high", high).where(~F.col("code").isin(0, 15)).select(*keys, "r", "c", F.explode(lines).alias("s"))
    return out.select(*keys, "r", "c", F.col("s.p.e").alias("e1"), F.col("s.q.e").alias("e2"), F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def contour_stats(segments: DataFrame, keys=("scene",)) -> DataFrame:
    return segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("total_length"))
