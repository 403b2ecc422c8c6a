"""Overlay of references, predictions and masks on one grid, and what is counted while filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridmetric.sources.shared import Tables


def valid_pixels(df: DataFrame, reference: str, nodata=(255,), mask: str | None = None, mask_value: int = 1) -> DataFrame:
    """Rows whose reference isn't a nodata value (an empty set disables that) and whose mask, if any, has the value."""
    if nodata:
        df = df.where(~F.col(reference).isin(*nodata))
    return df if mask is None else df.where(F.col(mask) == mask_value)


def require_valid(df: DataFrame, keys, counted: str = "n_valid") -> DataFrame:
    """Rows of a count table; a group without valid pixels is an error when the row is evaluated."""
    message = F.concat(F.lit("no valid pixels in "), F.concat_ws("/", *keys))
    return df.withColumn(counted, F.when(F.col(counted) > 0, F.col(counted)).otherwise(F.raise_error(message).cast("long")))


def overlay(reference: DataFrame, prediction: DataFrame, mask: DataFrame | None = None, on=("scene", "r", "c"), boundless: bool = False) -> DataFrame:
    """Reference and prediction on equal cells; with a mask its column msk, where cells outside it read 0 if boundless and go otherwise."""
    both = reference.join(prediction, list(on), "inner")
    if mask is None:
        return both
    joined = both.join(mask, list(on), "left" if boundless else "inner")
    return joined.withColumn("msk", F.coalesce("msk", F.lit(0))) if boundless else joined


def shift_grid(df: DataFrame, row_offset: int, col_offset: int) -> DataFrame:
    """The same cells counted from another raster's origin."""
    return df.withColumn("r", F.col("r") + row_offset).withColumn("c", F.col("c") + col_offset)


def bounds_intersection(pairs: DataFrame, a: str, b: str, fail_when_empty: bool = False) -> DataFrame:
    """left, bottom, right, top of the overlap of extents a_* and b_*; empty overlaps go, or fail."""
    low = {k: F.greatest(f"{a}_{k}", f"{b}_{k}").alias(k) for k in ("left", "bottom")}
    high = {k: F.least(f"{a}_{k}", f"{b}_{k}").alias(k) for k in ("right", "top")}
    out = pairs.select("*", *low.values(), *high.values())
    some = (F.col("left") < F.col("right")) & (F.col("bottom") < F.col("top"))
    if fail_when_empty:
        return out.withColumn("left", F.when(some, F.col("left")).otherwise(F.raise_error(F.lit("extents don't overlap")).cast("double")))
    return out.where(some)


#: Entries of a cell beyond which it is dealt into parts of about so many, the one extent in so many by which cells are counted, the most tasks that parts are for.
PART, SHOWN, TASKS = 2048, 16, 1024
#: The most parts of a kind in a cell, unless parts would exceed MOST entries: an extent is copied once a part that it meets, so few parts keep the exchange small.
PARTS, MOST = 16, 65536
#: Kinds of entries that meet in a cell. A kind's bits: 2 if the cell's x is the extent's first, 1 if its y is, 4 if the extent is of a finer level. Either
#: extent must begin there in x and either in y; two of the same level meet once.
MEETS = [(x, y) for x in range(8) for y in range(4) if (x | y) & 3 == 3 and (x >= 4 or x >= y)]


def overlapping_extents(extents: DataFrame, key: str = "k", sides=("left", "bottom", "right", "top")) -> DataFrame:
    """a_key, b_key and the sides of the overlap of every two extents that overlap, the smaller key first. Extents without an area or a key take no
    part; keys are distinct.

    Each extent lies on the grid level whose cells are the least that are at least as large as it is, so that it covers four cells at most there and on
    any coarser level. It is entered on its own level, and looks for others on that and each coarser level that there is: its entries are four cells a
    level, however large or small extents are. Levels double, so they are few; the driver holds their list. A pair counts in the first cell that both cover.

    A cell with more than PART entries is dealt into parts of each kind, and only kinds that can have a pair there meet, every two parts under a key of their
    own: a task holds some parts of at most about MOST entries. An extent is copied once a part that it meets. Up to PARTS * MOST entries of a kind in a
    cell these are PARTS at most, so that the exchange grows with the extents and not with their pairs; beyond, with their square over MOST. Extents are
    stored once. Entries are a hash of their cell and the extent, nothing else; the pair's first cell tells it again. Dealt cells have numbers of their own.
    """
    left, bottom, right, top = sides
    own = extents.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(n) for c, n in zip(sides, ("l", "b", "r", "t"))]).where("k IS NOT NULL AND l < r AND b < t")
    tables = Tables(extents.sparkSession, "cells")
    own = tables.keep(own)
    mean = own.agg(F.avg(F.col("r") - F.col("l")).alias("w"), F.avg(F.col("t") - F.col("b")).alias("h")).first()
    if mean.w is None:
        mean = Row(w=1.0, h=1.0)
    size = F.greatest((F.col("r") - F.col("l")) / mean.w, (F.col("t") - F.col("b")) / mean.h)
    own = own.withColumn("level", F.ceil(F.log2(size)).cast("int"))
    levels = sorted(r.level for r in own.select("level").distinct().collect())
    place = lambda v, unit, scale: F.floor(v / (scale * unit))
    grid = F.array(*[F.struct(F.lit(x).alias("level"), F.pow(F.lit(2.0), F.lit(x)).alias("scale")) for x in levels or [0]])
    looks = own.withColumn("at", F.explode(F.filter(grid, lambda x: x["level"] >= F.col("level"))))
    scale = F.col("at.scale")
    span = lambda low, high, unit: F.sequence(place(F.col(low), unit, scale), place(F.col(high), unit, scale))
    over = looks.select("k", "l", "b", "r", "t", "level", "at", F.posexplode(span("l", "r", mean.w)).alias("i", "x"), span("b", "t", mean.h).alias("ys"))
    over = over.select("*", F.posexplode("ys").alias("j", "y"))
    bits = F.when(F.col("i") == 0, 2).otherwise(0) + F.when(F.col("j") == 0, 1).otherwise(0) + F.when(F.col("at.level") > F.col("level"), 4).otherwise(0)
    # A row for each cell that an extent covers; code is the cell's level and the entry's kind.
    entries = over.select(F.col("at.level").alias("level"), "x", "y", F.xxhash64("at.scale", "x", "y").alias("cell"), "k", "l", "b", "r", "t", (F.col("at.level") * 8 + bits).alias("code"))
    place_of = ["level", "x", "y"]
    kind = lambda code="code": F.col(code).bitwiseAND(7)
    some = entries.where(F.pmod(F.xxhash64("k"), F.lit(SHOWN)) == 0)  # only deals cells: the pairs are the same whichever are dealt
    held = some.groupBy(*place_of).agg(F.array(*[F.count_if(kind() == x) * SHOWN for x in range(8)]).alias("n"), (F.count("*") * SHOWN).alias("all")).where(F.col("all") > PART)
    parts = F.transform("n", lambda n: F.greatest(F.least(F.ceil(n / PART), F.greatest(F.lit(PARTS), F.ceil(n / MOST))), F.lit(1)).cast("int"))
    crowded = tables.keep(held.select(*place_of, parts.alias("n"), F.monotonically_increasing_id().alias("number")))  # a row for PART entries at most

    def pairs(a: DataFrame, b: DataFrame, on: list[str], counts: Column) -> DataFrame:
        a, b = (d.withColumnsRenamed({c: f"{n}_{c}" for c in d.columns if c not in on}) for d, n in ((a, "a"), (b, "b")))
        low, high = F.greatest("a_l", "b_l"), F.least("a_r", "b_r")
        down, up = F.greatest("a_b", "b_b"), F.least("a_t", "b_t")
        met = a.hint("merge").join(b, on).where(counts & (low < high) & (down < up))
        return met.select(F.least("a_k", "b_k").alias(f"a_{key}"), F.greatest("a_k", "b_k").alias(f"b_{key}"), low.alias(left), down.alias(bottom), high.alias(right), up.alias(top))

    def whole(rows: DataFrame) -> DataFrame:
        rows = rows.drop(*place_of)
        seen = F.col("a_code").bitwiseOR(F.col("b_code")).bitwiseAND(3) == 3
        scale = F.pow(F.lit(2.0), F.shiftright("b_code", 3))
        x, y = place(F.greatest("a_l", "b_l"), mean.w, scale), place(F.greatest("a_b", "b_b"), mean.h, scale)
        same = F.xxhash64(scale, x, y) == F.col("cell")  # not another cell of the same hash
        return pairs(rows, rows.where(kind() < 4), ["cell"], seen & ((kind("a_code") >= 4) | (F.col("a_k") < F.col("b_k"))) & same)

    ways = lambda n: sum((F.when(F.lit(x == y), n(x) * (n(x) + 1) / 2).otherwise(n(x) * n(y)) for x, y in MEETS), F.lit(0))
    met = crowded.agg(F.sum(ways(lambda x: F.get("n", F.lit(x)).cast("long"))).cast("long").alias("n")).first().n
    if not met:
        return whole(entries)

    def dealt(second: bool) -> DataFrame:
        """An entry's copies: one for each part that its own meets, under the number of their kinds' meeting and those of the first's and the second's part."""
        d = entries.join(F.broadcast(crowded), place_of).withColumn("p", F.pmod(F.xxhash64("k"), F.get("n", kind())).cast("int"))
        keys = []
        for m, (x, y) in enumerate(MEETS):
            last = F.get("n", F.lit(x if second else y)) - 1
            others = F.sequence(F.lit(0) if second or x != y else F.col("p"), F.col("p") if second and x == y else last)
            key = lambda o: F.struct(F.lit(m).alias("m"), (o if second else F.col("p")).alias("i"), (F.col("p") if second else o).alias("j"))  # noqa: B023, E731
            keys.append(F.when(kind() == (y if second else x), F.transform(others, key)))
        at = d.withColumn("at", F.explode(F.flatten(F.array_compact(F.array(*keys)))))
        return at.select("number", "at.*", "k", "l", "b", "r", "t").repartition(min(TASKS, met), "number", "m", "i", "j")

    alone = entries.join(F.broadcast(crowded), place_of, "left_anti")
    once = (F.col("m") != MEETS.index((3, 3))) | (F.col("i") != F.col("j")) | (F.col("a_k") < F.col("b_k"))
    return whole(alone).unionByName(pairs(dealt(False), dealt(True), ["number", "m", "i", "j"], once))


def overlap_diagnostics(df: DataFrame, keys, reference: Column, mask: Column, water=(1,), nodata=(255,), mask_value: int = 1) -> DataFrame:
    """Pixels in all, after each filter, and water and land among the valid ones, in one pass."""
    in_ref, in_mask = ~reference.isin(*nodata), mask == mask_value
    count = lambda cond, name: F.count_if(cond).alias(name)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"), count(in_ref, "n_reference"), count(in_mask, "n_mask"), count(in_ref & in_mask, "n_valid"),
        count(in_ref & in_mask & reference.isin(*water), "n_water"), count(in_ref & in_mask & ~reference.isin(*water), "n_land"))


def compare_pools(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Per first key: sizes of two pixel pools, common pixels, those on one side alone, coverage of each by the other, and whether they are equal."""
    group = keys[0]
    both = a.select(*keys, F.lit(True).alias("in_a")).join(b.select(*keys, F.lit(True).alias("in_b")), list(keys), "full")
    ina, inb = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    out = both.groupBy(group).agg(
        F.count_if(ina).alias("n_a"), F.count_if(inb).alias("n_b"), F.count_if(ina & inb).alias("n_both"),
        F.count_if(ina & ~inb).alias("only_a"), F.count_if(inb & ~ina).alias("only_b"))
    return out.withColumn("coverage_a", F.try_divide("n_both", "n_a")).withColumn("coverage_b", F.try_divide("n_both", "n_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def transform_diff(df: DataFrame, base: str, other: str, geographic: Column, center_lat: Column) -> DataFrame:
    """Greatest difference of affine coefficients in units, metres and pixels."""
    from gridmetric.functions.scalar import meters_per_degree

    lon, lat = meters_per_degree(center_lat)
    mx, my = F.when(geographic, lon).otherwise(1.0), F.when(geographic, lat).otherwise(1.0)
    diff = F.zip_with(base, other, lambda a, b: F.abs(a - b))
    x, y = F.array_max(F.slice(diff, 1, 3)) * mx, F.array_max(F.slice(diff, 4, 3)) * my
    px_x, px_y = F.abs(F.element_at(base, 1) * mx), F.abs(F.element_at(base, 5) * my)
    return df.select("*", F.array_max(diff).alias("max_abs_diff"), F.greatest(x, y).alias("max_diff_m"), F.greatest(F.try_divide(x, px_x), F.try_divide(y, px_y)).alias("max_diff_px"))
