"""Listings, tables with fixed schemas, and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.schemas import require_columns


def listing(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of the files under root that match, found by the file system that Spark reads."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "modificationTime", "length").orderBy("path")


def input_images(spark: SparkSession, list_file: str | None = None, paths: list[str] | None = None, directory: str | None = None, pattern: str = "*.tif", single: str | None = None) -> DataFrame:
    """path of the wanted images: a list file (blank lines and # left out), else a list, else a directory, else one path."""
    if list_file:
        lines = spark.read.text(list_file).select(F.trim("value").alias("path"))
        return lines.where((F.col("path") != "") & ~F.col("path").startswith("#"))
    if paths:
        return spark.createDataFrame([(p,) for p in paths], "path string")
    if directory:
        return listing(spark, directory, pattern, False).select("path")
    if single:
        return spark.createDataFrame([(single,)], "path string")
    raise ValueError("no input images are named")


def discover(paths: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """model, base, tiling, scene of .../model/scene/file paths; a model without a known tiling suffix is an error when evaluated."""
    from gridmetric.functions.scalar import first_suffix, strip_suffix

    parts = F.split("path", "/")
    model, scene = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    tiling = F.coalesce(first_suffix(model, suffixes), F.raise_error(F.concat(F.lit("unknown tiling of "), model)).cast("string"))
    return paths.select("path", model.alias("model"), strip_suffix(model, list(suffixes)).alias("base"), tiling.alias("tiling"), scene.alias("scene"))


def read_csv(spark: SparkSession, path: str, schema: str, required=()) -> DataFrame:
    """A CSV table with a header and a fixed schema, so an empty file is an empty table."""
    return require_columns(spark.read.schema(schema).option("header", True).csv(path), required)


def read_scene_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_trials(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Trials of a study store over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history by step, without private columns."""
    df = spark.read.json(path)
    return df.select(*[c for c in df.columns if not c.startswith("_")]).orderBy("global_step")


def collate(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV summaries of several runs with run_dir and run_name (without its time stamp)."""
    from gridmetric.functions.scalar import strip_run_timestamp

    df = spark.read.schema(schema).option("header", True).csv(path).withColumn("run_dir", F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-2)))
    return df.withColumn("run_name", strip_run_timestamp("run_dir"))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for small result tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_manifest(df: DataFrame, path: str, schema: str) -> None:
    """Appends rows in a fixed order of columns; columns that df lacks are empty text."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit("").cast(f.dataType) if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]).write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def write_scene_output(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Partitioned by run_id and scene_id; existing output is an error unless overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("run_id", "scene_id").parquet(path)


def geojson_lines(contours: DataFrame) -> DataFrame:
    """One GeoJSON feature a row from contour_id, vertices (array of x, y) and further columns as properties."""
    props = [c for c in contours.columns if c != "vertices"]
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("vertices", lambda v: F.array(v["x"], v["y"])).alias("coordinates"))
    return contours.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("value"))


def content_sums(df: DataFrame) -> list[Column]:
    """Number of rows and two sums of hashes over all columns, which don't depend on the order of rows; what is written and what is read agree in them
    unless a value, its column or a row's number of copies differs (but for a chance of about 2 ** -64)."""
    kept = lambda f: F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    columns = [kept(f) for f in df.schema.fields]
    each = [F.xxhash64(F.lit(seed), *columns, *[F.isnull(c) for c in columns]).cast("decimal(38,0)") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k, h in enumerate(each)]]


def validated_copy(df: DataFrame, path: str, source: str | None = None) -> int:
    """Writes, reads again and compares columns, their types and the content of all rows; returns the count. The source folder, if named, goes only after
    that.

    The copy is written beside the path and renamed once it has been read again and agrees with the source, whose sums are taken from the source itself:
    until then the path, the source and what the path held before stay as they are.
    """
    from gridmetric.sources.shared import clean_up, rename

    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.part"
    df.write.parquet(beside)
    want = df.agg(*content_sums(df)).first().asDict()
    back = spark.read.parquet(beside)
    got = back.agg(*content_sums(back)).first().asDict()
    types = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema.fields]
    if got != want or types(back) != types(df):
        clean_up(spark, [beside])
        raise ValueError(f"{path}: {got['n']} rows were written of {want['n']}" if got["n"] != want["n"] else f"{path}: what was written differs from the source")
    rename(spark, beside, path)
    if source is not None:
        clean_up(spark, [source])
    return want["n"]


def json_safe(value) -> str:
    return json.dumps(value, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))
