"""Segments of iso-lines chained to contours, without a task that holds more than one block's segments or one run of them.

Segments follow each other where one ends on the grid edge on which another begins; an edge begins and ends one segment at most. Each block of cells
chains its own segments to runs. Runs meet by exchanges, never by copies to all tasks, which the driver would gather. What runs form across blocks is found by pointer jumping: each run knows a run before it and how far that is, and
asks it for its own, so that the distance doubles from round to round. Rings, which have no first run, are cut at the least edge of all their segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmetric.operators.geometry import VERTICES
from gridmetric.sources.shared import Tables

#: Rows and columns of cells in a block.
BLOCK = 512


def chain_order(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the number of the first one of its chain, and its place there. Rings begin at their least start."""
    n = len(start)
    by_start = np.argsort(start, kind="stable")
    at = np.searchsorted(start[by_start], end)
    follows = (at < n) & (start[by_start[np.minimum(at, n - 1)]] == end) if n else np.zeros(0, bool)
    before = np.arange(n)
    before[by_start[at[follows]]] = np.flatnonzero(follows)
    for _ in range(2):
        first, place, least = before.copy(), (before != np.arange(n)).astype(np.int64), start.copy()
        for _ in range(max(1, n).bit_length()):
            place, least, first = place + place[first], np.minimum(least, least[first]), first[first]
        ring = before[first] != first
        if not ring.any():
            break
        cut = ring & (start == least)
        before[cut] = np.flatnonzero(cut)
    return first, place


def _runs_of(table: pa.Table, keys: list[str]) -> pa.Table:
    """Runs of one block: keys, first and last edge, least edge and its place, number of segments, length and vertices."""
    take = lambda name: table[name].to_numpy()
    start, end, x1, y1, x2, y2 = (take(c) for c in ("e1", "e2", "x1", "y1", "x2", "y2"))
    first, place = chain_order(start, end)
    order = np.lexsort((place, first))
    begins = np.flatnonzero(place[order] == 0)
    sizes = np.diff(np.append(begins, len(order)))
    s, e = start[order], end[order]
    last = begins + sizes - 1
    least = np.minimum.reduceat(s, begins) if len(begins) else s
    number = np.repeat(np.arange(len(begins)), sizes)
    where = np.flatnonzero(s == least[number])
    length = np.add.reduceat(np.hypot(x2 - x1, y2 - y1)[order], begins) if len(begins) else np.zeros(0)
    # A run has one vertex more than segments: the end of its last one.
    offsets = np.append(0, np.cumsum(sizes + 1)).astype(np.int32)
    own = np.arange(len(order)) + number
    xs, ys = np.empty(len(order) + len(begins)), np.empty(len(order) + len(begins))
    xs[own], ys[own], xs[offsets[1:] - 1], ys[offsets[1:] - 1] = x1[order], y1[order], x2[order][last], y2[order][last]
    points = pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], names=["x", "y"])
    same = {k: pa.repeat(table[k][0], len(begins)) for k in keys}
    return pa.table({**same, "s": s[begins], "e": e[last], "least": least, "least_at": where - begins, "n": sizes.astype(np.int64), "length": length, "vertices": pa.ListArray.from_arrays(offsets, points)})


def block_runs(segments: DataFrame, keys=("scene",), block: int = BLOCK) -> DataFrame:
    """Runs of segments (keys, r, c, e1, e2, x1, y1, x2, y2) within blocks of block x block cells. A task takes a block's segments at a time."""
    names = [f"k{i}" for i in range(len(keys))]
    own = segments.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.expr(f"r div {block}").alias("br"), F.expr(f"c div {block}").alias("bc"), "e1", "e2", "x1", "y1", "x2", "y2")
    schema = StructType([own.schema[n] for n in names]).add("s", "long").add("e", "long").add("least", "long").add("least_at", "long").add("n", "long").add("length", "double")
    schema = StructType([*schema.fields, *StructType.fromDDL(f"vertices {VERTICES}").fields])
    runs = own.groupBy(*names, "br", "bc").applyInArrow(lambda t: _runs_of(t.combine_chunks(), names), schema)
    return runs.withColumnsRenamed(dict(zip(names, keys)))


def _jump(tables: Tables, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, ptr, dist, least, done after pointer jumping: done rows have their first run in ptr, and the others stand in rings of least `least`."""
    while True:
        there = nodes.select(*keys, F.col("s").alias("ptr"), *[F.col(c).alias(f"_{c}") for c in ("ptr", "dist", "least", "done")])
        low = F.least("least", "_least")
        moved = nodes.join(there.hint("merge"), [*keys, "ptr"]).select(
            *keys, "s", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), low.alias("least"), F.col("_done").alias("done"),
            ((F.col("done") != F.col("_done")) | (low != F.col("least"))).alias("changed"))
        after = tables.keep(moved)
        going = after.where("changed").limit(1).count()
        tables.drop(nodes)
        nodes = after.drop("changed")
        nodes._path = after._path
        if not going:
            return nodes


def contour_parts(segments: DataFrame, keys=("scene",), block: int = BLOCK) -> DataFrame:
    """keys, contour_id, part, s, e, n, length, vertices: the runs of each contour in order, with their first and last grid edge.

    Segments of a null key take no part. contour_id is the grid edge on which a contour begins; a ring begins, and ends, on its least one. It doesn't depend on the size of a block.
    The written tables hold one row a run; the last is the result's own.
    """
    keys = list(keys)
    tables = Tables(segments.sparkSession, "contours")
    runs = tables.keep(block_runs(segments, keys, block))

    def linked(runs: DataFrame, cut: Column) -> DataFrame:
        """Each run with the run that ends where it begins, or itself where there is none or it is cut there."""
        ends = runs.select(*keys, F.col("e").alias("s"), F.col("s").alias("before"))
        both = runs.withColumn("cut", cut).select(*keys, "s", "e", "least", "cut").join(ends.hint("merge"), [*keys, "s"], "left").withColumn("first", F.col("before").isNull() | (F.col("before") == F.col("s")) | F.col("cut"))
        return both.select(*keys, "s", F.when(F.col("first"), F.col("s")).otherwise(F.col("before")).alias("ptr"), F.when(F.col("first"), 0).otherwise(1).cast("long").alias("dist"), "least", F.col("first").alias("done"))

    placed = _jump(tables, tables.keep(linked(runs, F.lit(False))), keys)
    if placed.where("NOT done").limit(1).count():  # rings over several blocks
        ring = placed.where("NOT done").select(*keys, "s", F.col("least").alias("ring_least"))
        here = F.col("least") == F.col("ring_least")
        own = runs.join(ring.hint("merge"), [*keys, "s"], "left").withColumn("split", F.coalesce(here & (F.col("least_at") > 0), F.lit(False)))
        # The run that holds the ring's least edge is parted there; lengths of its parts follow from their vertices.
        ends = lambda a, n: F.slice("vertices", a, n)
        at = F.col("least_at").cast("int")
        back = F.struct(F.col("s").alias("s"), F.col("least").alias("e"), F.col("least_at").alias("n"), ends(F.lit(1), at + 1).alias("vertices"))
        front = F.struct(F.col("least").alias("s"), F.col("e").alias("e"), (F.col("n") - F.col("least_at")).alias("n"), ends(at + 1, F.size("vertices")).alias("vertices"))
        whole = F.struct("s", "e", "n", "vertices")
        parted = own.withColumn("p", F.explode(F.when(F.col("split"), F.array(back, front)).otherwise(F.array(whole))))
        runs = tables.keep(parted.select(*keys, "p.s", "p.e", "p.n", F.when(F.col("split"), _length(F.col("p.vertices"))).otherwise(F.col("length")).alias("length"), "p.vertices", "least", F.coalesce(F.col("p.s") == F.col("ring_least"), F.lit(False)).alias("cut")))
        placed = _jump(tables, tables.keep(linked(runs, F.col("cut"))), keys)
    return runs.join(placed.select(*keys, "s", F.col("ptr").alias("contour_id"), F.col("dist").alias("part")).hint("merge"), [*keys, "s"]).select(*keys, "contour_id", "part", "s", "e", "n", "length", "vertices")


def _length(v: Column) -> Column:
    steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def contour_lengths(parts: DataFrame, keys=("scene",)) -> DataFrame:
    """keys, contour_id, n_vertices, length of contours that have a length: sums over their parts, whose vertices stay where they are."""
    sums = parts.groupBy(*keys, "contour_id").agg((F.sum("n") + 1).alias("n_vertices"), F.sum("length").alias("length"))
    return sums.where(F.col("length") > 0)


def contour_lines(parts: DataFrame, keys=("scene",)) -> DataFrame:
    """keys, contour_id, vertices: each contour as one row, which holds its whole line. For chosen contours; parts serve for all others."""
    own = parts.groupBy(*keys, "contour_id").agg(F.array_sort(F.collect_list(F.struct("part", "vertices"))).alias("p"))
    heads = F.flatten(F.transform("p", lambda x: F.slice(x["vertices"], 1, F.size(x["vertices"]) - 1)))  # a part begins where the one before ends
    return own.select(*keys, "contour_id", F.concat(heads, F.slice(F.element_at("p", -1)["vertices"], -1, 1)).alias("vertices"))


def extract_contours(canvas: DataFrame, root: str, level: float, value: str = "p", overwrite: bool = False, dry_run: bool = False, at_once: int = 64, block: int = BLOCK) -> DataFrame:
    """scene and action (skip, extract or would_extract) of every scene of the canvas, whose contours are written to root/lines by scene.

    A scene is done when root/done names it, which is written after its lines: a scene whose writing was cut short is extracted again, and its lines
    replaced. Scenes are written at_once at a time, so that what was done before a failure is not done again. The driver holds the names of the scenes.
    """
    from gridmetric.operators.geometry import batch_status, iso_segments
    from gridmetric.sources.shared import _glob

    spark = canvas.sparkSession
    scenes = canvas.select("scene").distinct()
    there = _glob(spark, f"{root}/done/part-*")[1]
    done = spark.read.parquet(f"{root}/done") if there else scenes.limit(0)
    status = [(r.scene, r.action) for r in batch_status(scenes, done, overwrite=overwrite, dry_run=dry_run).orderBy("scene").collect()]
    todo = [scene for scene, action in status if action == "extract"]
    for k in range(0, len(todo), at_once):
        some = todo[k : k + at_once]
        parts = contour_parts(iso_segments(canvas.where(F.col("scene").isin(some)), level, value=value), block=block)
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene").parquet(f"{root}/lines")
        spark.createDataFrame([(scene,) for scene in some], StructType([canvas.schema["scene"]])).coalesce(1).write.mode("append").parquet(f"{root}/done")
    return spark.createDataFrame(status, StructType([canvas.schema["scene"], *StructType.fromDDL("action string").fields]))
