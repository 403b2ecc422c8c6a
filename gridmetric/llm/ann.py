"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is rotated into a space of BITS bits or more; its code is the signs of its coordinates there, packed into bytes and stored once, with
two correction scalars: its norm and the inner product of its direction with its code's direction. The inner product of a query's rotated
coordinates with a code's signs, corrected by the scalars, estimates that of the vectors; an error bound holds with high probability. The best by
estimate are computed exactly, and then those vectors whose upper bound reaches the k-th of these products.

Equal vectors are one candidate with their least ids (more than k of them can't be among a query's k nearest).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmetric.llm.common import Scratch, quoted, table

#: Bits of a code at least: a longer code has a smaller error, which falls with the root of its length.
BITS = 512


@functools.lru_cache(maxsize=8)
def rotation(dim: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """A random matrix with orthonormal columns from dim coordinates to a multiple of 64, bits at least."""
    size = max(bits, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of vectors (rows of packed bytes) and their correction scalars."""

    def __init__(self, packed: np.ndarray, norm: np.ndarray, align: np.ndarray):
        self.packed, self.norm, self.align = packed, norm, align

    @classmethod
    def of(cls, vectors: np.ndarray) -> Codes:
        rotated = vectors @ rotation(vectors.shape[1]).T
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        align = np.abs(rotated).sum(axis=1) / (np.sqrt(rotated.shape[1]) * norm)  # <direction, code>
        return cls(np.packbits(rotated >= 0, axis=1, bitorder="little"), norm, align)

    def signs(self) -> np.ndarray:
        return np.unpackbits(self.packed, axis=1, bitorder="little").astype(np.float32) * 2 - 1

    def estimate(self, queries: np.ndarray, sure: float, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x codes) and the bound on their error, which holds but for a chance of about exp(-sure**2 / 2)."""
        signs = self.signs() if signs is None else signs
        size = signs.shape[1]
        rotated = (queries @ rotation(queries.shape[1]).T).astype(np.float32)
        scale = self.norm / (self.align * np.sqrt(size))
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        spread = np.sqrt(np.maximum(0, 1 - self.align**2) / max(1, size - 1)) / self.align
        return (rotated @ signs.T) * scale, norms * (self.norm * (sure * spread + 1e-5))  # the last for sums in single precision


def search_block(queries: np.ndarray, vectors: np.ndarray, codes: Codes, k: int, sure: float, first: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the rows that may be among its k nearest, and their exact inner products.

    The `first` best by estimate (2 k at least) are computed exactly, and the k-th of them is a floor: of the other rows only those whose upper bound
    reaches it are computed.
    """
    signs, first = codes.signs(), max(first, 2 * k)
    for a in range(0, len(queries), 256):
        some = queries[a : a + 256]
        est, err = codes.estimate(some, sure, signs)
        if est.shape[1] <= first:
            for q in some:
                yield np.arange(len(vectors)), (vectors * q).sum(axis=1)
            continue
        best = np.argpartition(-est, first - 1, axis=1)[:, :first]
        for q, top, row, bound in zip(some, best, est, err):
            exact = (vectors[top] * q).sum(axis=1)
            reach = row + bound >= np.partition(exact, -k)[-k]
            reach[top] = False
            more = np.flatnonzero(reach)
            yield np.concatenate([top, more]), np.concatenate([exact, (vectors[more] * q).sum(axis=1)])


def with_codes(distinct: DataFrame) -> DataFrame:
    """ids, id and v (vectors of any lengths) besides code, norm and align."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            flat, begin = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            code, norm, align = [None] * len(v), np.zeros(len(v)), np.zeros(len(v))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                made = Codes.of(flat[begin[rows][:, None] + np.arange(dim)])
                norm[rows], align[rows] = made.norm, made.align
                for i, c in zip(rows, made.packed):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(norm), pa.array(align)], names=[*batch.schema.names, "code", "norm", "align"])

    return distinct.select("ids", "id", "v").mapInArrow(run, "ids array<long>, id long, v array<double>, code binary, norm double, align double")


def valid_vectors(table_: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = quoted(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = table_.where(quoted(vector_col).isNotNull() & quoted(id_col).isNotNull())
    return own.where(good).select(quoted(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(base: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, sure: float = 3.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row, by inner product in double precision.

    is_query: a condition on the column `id`. Rows with a null id, or a vector that is null, empty, zero or has null or non-finite components
    take no part; vectors meet those of their own length alone. Ties go to the smaller id; of rows with one id and vector one counts. With fewer
    than k others, all are returned; an empty table gives an empty result. Work is queries x codes, in blocks of `block` vectors;
    the code of every row is compared, so only the error bounds (sure) can lose a neighbour.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "ann")
    rows = valid_vectors(base, id_col, vector_col)
    nth = Window.partitionBy("v").orderBy("id")
    same = rows.distinct().withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    # Distinct vectors with the least ids that have them: no more than k + 1 rows of a group get here.
    distinct = scratch.keep(with_codes(same.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("id"))), "distinct")
    sizes = distinct.groupBy(F.size("v").alias("dim")).count().collect()
    asked = scratch.keep(rows.where(is_query).distinct(), "asked")
    asks = asked.groupBy("v").agg(F.min("id").alias("id"))
    n_queries = asks.groupBy(F.size("v").alias("dim")).count().collect()
    blocks = {r["dim"]: max(1, -(-r["count"] // block)) for r in sizes}
    q_blocks = {r["dim"]: max(1, -(-r["count"] // block)) for r in n_queries}

    def number(col, of: dict):
        """Block of a row, by a hash of its id over the blocks of its length."""
        counts = F.create_map(*[F.lit(x) for kv in of.items() for x in kv]) if of else F.create_map(F.lit(0), F.lit(1))
        return F.pmod(F.xxhash64(col), F.coalesce(F.try_element_at(counts, F.size("v")), F.lit(1)))

    def counts_of(of: dict):
        counts = F.create_map(*[F.lit(x) for kv in of.items() for x in kv]) if of else F.create_map(F.lit(0), F.lit(1))
        return F.coalesce(F.try_element_at(counts, F.size("v")), F.lit(1))

    data = distinct.select(F.size("v").alias("dim"), number("id", blocks).cast("int").alias("b"), "ids", "v", "code", "norm", "align")
    data = data.withColumn("q", F.explode(F.expr("sequence(0, 0)")) if max(q_blocks.values(), default=1) == 1 else F.explode(F.sequence(F.lit(0), (counts_of(q_blocks) - 1).cast("int"))))
    ask = asks.select(F.size("v").alias("dim"), number("id", q_blocks).cast("int").alias("q"), "id", "v", F.explode(F.sequence(F.lit(0), (counts_of(blocks) - 1).cast("int"))).alias("b"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"asked": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        left, right = left.combine_chunks(), right.combine_chunks()
        dim = left["dim"][0].as_py()
        unnest = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        queries, vectors = unnest(left), unnest(right)
        packed = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(vectors), -1)
        codes = Codes(packed, right["norm"].to_numpy(), right["align"].to_numpy())
        ids, asked_ids = right["ids"].combine_chunks(), left["id"].to_numpy()
        flat, begin = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        out_q, out_id, out_s = [], [], []
        for q, (found, score) in enumerate(search_block(queries, vectors, codes, k + 1, sure)):
            order = np.argsort(-score, kind="stable")
            if len(order) > k + 1:
                floor = score[order[k]]
                order = order[score[order] >= floor]
            found, score = found[order], score[order]
            n = np.diff(begin)[found]
            all_ids = np.concatenate([flat[begin[f] : begin[f + 1]] for f in found])
            all_scores = np.repeat(score, n)
            best = np.lexsort((all_ids, -all_scores))[: k + 1]
            out_q.append(np.full(len(best), asked_ids[q]))
            out_id.append(all_ids[best])
            out_s.append(all_scores[best])
        return pa.table({"asked": np.concatenate(out_q), "id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    found = ask.groupBy("dim", "q", "b").cogroup(data.groupBy("dim", "q", "b")).applyInArrow(match, "asked long, id long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    lists = top.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("near"))
    own = asked.join(asks.select("v", F.col("id").alias("asked")), "v").select(F.col("id").alias("query_id"), "asked")
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.join(lists, "asked").select("query_id", F.posexplode(near).alias("r", "x")).select(
        "query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.down")).alias("score"))


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
