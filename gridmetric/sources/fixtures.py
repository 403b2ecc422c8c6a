"""Raster-domain relations derived from the star-schema tables: wide and long pixel tables, chips, manifests.

Each adapter is integer arithmetic, written once as SQL text; only integer division differs between engines (`div` and `//`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers of the members' pseudo-noise. Mechanism: A, B, C. Member: A, B, C, D, scale, mechanism.
MECHANISMS = ((3571, 27644, 61), (5003, 62141, 67), (7333, 91193, 71))
MEMBERS = (
    (7919, 104729, 31, 17, 300, 0), (6101, 15485, 37, 101, 280, 0), (4099, 32452, 41, 211, 260, 0), (2713, 49979, 43, 307, 380, 1),
    (9973, 67867, 47, 401, 420, 1), (1543, 86028, 53, 503, 460, 1), (8887, 13499, 59, 601, 400, 2),
)
N = len(MEMBERS)
MECHANISM_NAMES = ("CNN", "Transformer", "Hybrid")


def _p(k: int, div: str) -> str:
    a, b, c, d, s, m = MEMBERS[k]
    ga, gb, gc = MECHANISMS[m]
    g = f"((l_partkey * {ga} + l_suppkey * {gb} + l_orderkey * {gc}) % 1001)"
    h = f"((l_partkey * {a} + l_suppkey * {b} + l_orderkey * {c} + l_linenumber * {d}) % 1001)"
    return f"CAST(CASE WHEN l_returnflag = 'R' THEN {s} ELSE 0 END + (((3 * {g} + 2 * {h}) {div} 5) * {1000 - s}) {div} 1000 AS DOUBLE) / 1000"


#: Order of a scene's pixels.
PIXELS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")


def pxw_columns(div: str, wanted=None) -> list[str]:
    """SQL of the wide pixel table's columns over lineitem; for Spark, over lineitem with pixels numbered already."""
    pix = f"(row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY {', '.join(PIXELS)}) - 1)" if div == "//" else "pix"
    cols = {
        "scene": "CAST(year(l_shipdate) AS INT)", "pix": f"CAST({pix} AS BIGINT)",
        "ref": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 255 END", "msk": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
        "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "vv": "-28.0D + l_quantity / 2".replace("D", "" if div == "//" else "D"),
        "vh": "-33.0D + l_tax * 200".replace("D", "" if div == "//" else "D"), **{f"p_{k}": _p(k, div) for k in range(N)},
    }
    return [f"{sql} AS {name}" for name, sql in cols.items() if wanted is None or name in wanted]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def pxw(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Wide pixel table: scene, pix, ref, msk, y, vv, vh, p_0 ... p_6 (or the wanted ones of them)."""
    from gridmetric.operators.ranking import number_within

    rows = lineitem(spark, sf_dir)
    if not wanted or "pix" in wanted:
        rows = number_within(rows, F.year("l_shipdate"), PIXELS, "pix")
    return rows.selectExpr(*pxw_columns("div", wanted or None))


def with_grid(df: DataFrame, width: int = 100) -> DataFrame:
    """Adds row and column of a raster that is `width` pixels wide."""
    return df.selectExpr("*", f"CAST(pix div {width} AS INT) AS r", f"CAST(pix % {width} AS INT) AS c")


def valid(df: DataFrame, nodata=(255,), mask_value: int | None = 1) -> DataFrame:
    from gridmetric.operators.overlay import valid_pixels

    return valid_pixels(df, "ref", nodata, "msk" if mask_value is not None else None, mask_value)


def pxw_valid(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    return valid(pxw(spark, sf_dir, *({"ref", "msk", *wanted} if wanted else ())))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel table of valid pixels: model_name, scene, y, p. Scores don't need a pixel's number, so none is made."""
    wide = pxw_valid(spark, sf_dir, "scene", "y", *(f"p_{k}" for k in range(N)))
    stack = ", ".join(f"'m{k}', p_{k}" for k in range(N))
    return wide.selectExpr("scene", "y", f"stack({N}, {stack}) AS (model_name, p)")


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 on a mosaic with stride 4, 20 a row: tile_id, scene, y0, x0, values (array of double)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id AS tile_id", "label AS scene", "CAST(vec_id div 20 AS INT) * 4 AS y0", "CAST(vec_id % 20 AS INT) * 4 AS x0", "CAST(embedding AS ARRAY<DOUBLE>) AS values")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as manifest rows: user_id, event_type, value, ts, props, event_id."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


PXW_SQL = f"pxw AS (SELECT {', '.join(pxw_columns('//'))} FROM lineitem)"
PXV_SQL = f"{PXW_SQL}, pxv AS (SELECT * FROM pxw WHERE ref <> 255 AND msk = 1)"
PX_SQL = f"{PXV_SQL}, px AS (" + " UNION ALL ".join(f"SELECT 'm{k}' AS model_name, scene, pix, y, p_{k} AS p FROM pxv" for k in range(N)) + ")"
CHIP_SQL = "chip AS (SELECT vec_id AS tile_id, label AS scene, CAST(vec_id // 20 AS INT) * 4 AS y0, CAST(vec_id % 20 AS INT) * 4 AS x0, CAST(embedding AS DOUBLE[]) AS vals FROM embeddings)"
