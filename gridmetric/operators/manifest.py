"""Relations of runs: sweeps, evaluation entries, alignment checks, provenance, and the loop that benchmarks checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmetric.functions.scalar import prediction_type, sanitize_for_path

#: How a prediction of each spatial policy meets its reference.
SPATIAL_POLICIES = ("intersection", "exact")


def expand_sweep(checkpoints: DataFrame, presets: DataFrame, images: DataFrame) -> DataFrame:
    """Manifest of checkpoint x preset x image with run_id; the sides are a configuration's lists, the images may be many."""
    grid = images.crossJoin(F.broadcast(checkpoints)).crossJoin(F.broadcast(presets))
    return grid.withColumn("run_id", F.concat_ws("__", sanitize_for_path("checkpoint"), sanitize_for_path("preset"), sanitize_for_path("image")))


def evaluation_entries(manifest: DataFrame, keys, status: str = "status", code: str = "return_code") -> DataFrame:
    """keys, n_images, entry: groups of which every run succeeded become entries; the others are skipped."""
    from gridmetric.operators.ranking import group_success

    g = group_success(manifest, keys, status, code)
    return g.select(*keys, F.col("n").alias("n_images"), F.when(F.col("success"), "evaluate").otherwise("skipped_incomplete_group").alias("entry"))


def checked_policy(policy: str) -> str:
    if policy not in SPATIAL_POLICIES:
        raise ValueError(f"the spatial policy must be one of {SPATIAL_POLICIES}")
    return policy


def normalise_predictions(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn(kind, prediction_type(kind))


def safe_dirname(x: Column) -> Column:
    """A name for a folder: anything but letters, digits, dots and - becomes _."""
    return F.regexp_replace(x, "[^A-Za-z0-9.-]", "_")


def shorten(x: Column, most: int) -> Column:
    """x, or its beginning and an ellipsis where it is longer than `most` characters."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def alignment_status(df: DataFrame, tolerance_px: float = 0.5, crs: tuple[str, str] = ("crs_a", "crs_b"), shape: tuple[str, str] = ("shape_a", "shape_b"), diff_px: str = "max_diff_px") -> DataFrame:
    """The first check that two rasters fail, or `aligned`: coordinate systems, shapes, then transforms in pixels."""
    a, b = F.col(crs[0]), F.col(crs[1])
    status = F.when(~a.eqNullSafe(b), "crs_mismatch").when(~F.col(shape[0]).eqNullSafe(F.col(shape[1])), "shape_mismatch").when(F.coalesce(F.col(diff_px) > tolerance_px, F.lit(True)), "transform_mismatch")
    return df.withColumn("status", status.otherwise("aligned"))


def require_aligned(df: DataFrame, names, status: str = "status") -> DataFrame:
    """df; a row that isn't aligned is an error when it is evaluated."""
    message = F.concat(F.concat_ws("/", *names), F.lit(": "), F.col(status))
    return df.withColumn(status, F.when(F.col(status) == "aligned", F.col(status)).otherwise(F.raise_error(message).cast("string")))


def bounds_window(df: DataFrame, inner: str, outer: str, resolution: float) -> DataFrame:
    """row_off, col_off, height, width of the inner extent in the outer raster's grid (left and top), offsets and lengths rounded."""
    whole = lambda x: F.floor(x / resolution + 0.5).cast("int")
    c = lambda side, k: F.col(f"{side}_{k}")
    return df.select(
        "*", whole(c(outer, "top") - c(inner, "top")).alias("row_off"), whole(c(inner, "left") - c(outer, "left")).alias("col_off"),
        whole(c(inner, "top") - c(inner, "bottom")).alias("height"), whole(c(inner, "right") - c(inner, "left")).alias("width"))


def channel_fills(mode: str, means: list[float] | None, bands: int, value: float = 0.0) -> list[float]:
    """One fill value a band: a constant, or the channels' training means, of which there must be as many as bands."""
    if mode != "training_channel_mean":
        return [value] * bands
    if means is None or len(means) != bands:
        raise ValueError(f"{bands} bands need as many channel means")
    return [float(m) for m in means]


def merge_overrides(config: dict, overrides: dict) -> dict:
    """The configuration with every override that isn't None; dotted keys reach into sections."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items()}
    for key, value in overrides.items():
        if value is None:
            continue
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def merged_settings(runs: DataFrame, run: str, config: dict, columns: dict[str, str]) -> DataFrame:
    """run, key and value (text) of every run's configuration: the given one with the run's own columns over it, by dotted key, where they aren't null."""
    flat = {f"{k}.{n}": v for k, own in config.items() if isinstance(own, dict) for n, v in own.items()} | {k: v for k, v in config.items() if not isinstance(v, dict)}
    value = lambda key: F.coalesce(*([F.col(columns[key]).cast("string")] if key in columns else []), F.lit(str(flat[key])) if key in flat else F.lit(None))
    rows = F.array(*[F.struct(F.lit(key).alias("key"), value(key).alias("value")) for key in sorted({*flat, *columns})])
    return runs.select(run, F.explode(rows).alias("x")).select(run, "x.key", "x.value").where(F.col("value").isNotNull())


def provenance(runs: DataFrame, product: str, tags: dict[str, str]) -> DataFrame:
    """run_id, scene_id, path of the product ({run}/{scene}/{scene}_{product}), tags (a map of the row's and the fixed ones) and summary."""
    fixed = [F.lit(x) for kv in sorted(tags.items()) for x in kv]
    own = [x for c in ("run_id", "scene_id", "mode") for x in (F.lit(c), F.col(c))]
    path = F.concat_ws("/", "run_id", "scene_id", F.concat_ws("_", "scene_id", F.lit(product)))
    return runs.select("run_id", "scene_id", path.alias("path"), F.create_map(*own, *fixed).alias("tags"), F.concat_ws(" ", "mode", "status").alias("summary"))


def benchmark_loop(names: Iterable[str], infer: Callable[[str], DataFrame], evaluate: Callable[[DataFrame], DataFrame], clean: Callable[[str], None], rank: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each checkpoint is inferred, evaluated and cleaned before the next, so that one's outputs are on disk at a time; then all are ranked.

    keep writes a checkpoint's few result rows and returns them as they are read again.
    """
    results = None
    for name in names:
        rows = keep(evaluate(infer(name)), name)
        clean(name)
        results = rows if results is None else results.unionByName(rows)
    if results is None:
        raise ValueError("no checkpoints are named")
    return rank(results)
