"""Centroid clustering in whole numbers with partial-distance search.

A vector's squared differences from a centroid are added up over the dimensions of highest variance first. A centroid is abandoned once its sum is
strictly above the best full distance so far; those that survive finish all dimensions. Sums and means are exact integers, so that the result is the
same however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmetric.llm.common import Scratch, quoted, table

#: Dimensions that are added up between two looks at the sums.
STEP = 8
#: Greatest component of which 64 squared differences surely fit 64 bits; vectors beyond it are computed in Python's integers.
FITS = 1 << 27


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray, order: Sequence[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many terms were added up for it.

    order: the dimensions, those of highest variance first. The centroid that is nearest on the first `step` of them is finished first, which gives the
    bound that the others are held against.
    """
    n, dims = vectors.shape
    x, c = vectors[:, order], centroids[:, order]
    squares = lambda rows, k, a, b: ((x[rows, a:b] - c[k, a:b]) ** 2).sum(axis=1)
    head = min(step, dims)
    partial = np.stack([((x[:, :head] - own[:head]) ** 2).sum(axis=1) for own in c], axis=1)
    cluster = partial.argmin(axis=1).astype(np.int32)
    best = partial[np.arange(n), cluster] + ((x[:, head:] - c[cluster, head:]) ** 2).sum(axis=1)
    first, terms = cluster.copy(), n * (len(c) * head + dims - head)
    for k in range(len(c)):
        rows = np.flatnonzero((first != k) & (partial[:, k] <= best))
        total = partial[rows, k]
        for a in range(head, dims, step):
            b = min(a + step, dims)
            total = total + squares(rows, k, a, b)
            terms += len(rows) * (b - a)
            alive = total <= best[rows]
            rows, total = rows[alive], total[alive]
        closer = (total < best[rows]) | (k < cluster[rows])  # none is farther; of equally near ones the smaller number wins
        cluster[rows[closer]], best[rows[closer]] = k, total[closer]
    return cluster, best, terms


def _whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers of a column of doubles, in 64 bits, and the numbers of rows that are beyond FITS, which hold zeros."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    big = np.flatnonzero((np.abs(x) > FITS).any(axis=1)) if len(x) else np.zeros(0, np.int64)
    x[big] = 0
    return x.astype(np.int64), big


def _exact(column: pa.Array, row: int) -> np.ndarray:
    return np.array([[int(np.floor(v)) for v in column[row].as_py()]], object)


def _assign(column: pa.Array, centroids: np.ndarray, order: list[int]) -> tuple[np.ndarray, list[int], np.ndarray, dict[int, np.ndarray]]:
    """cluster, distance and vector of each row of a column of scaled components; vectors beyond 64 bits apart, by row."""
    x, big = _whole(column, centroids.shape[1])
    large = (np.abs(centroids) > FITS).any()
    cluster, distance, _ = nearest_centroid(x.astype(object) if large else x, centroids if large else centroids.astype(np.int64), order)
    distance, apart = distance.tolist(), {}
    for row in big.tolist():
        apart[row] = _exact(column, row)
        own, far, _ = nearest_centroid(apart[row], centroids, order)
        cluster[row], distance[row] = own[0], far[0]
    return cluster, distance, x, apart


def _sums(kept: DataFrame, centroids: np.ndarray, order: list[int]) -> list[tuple[int, list[int]]]:
    """For each cluster that has vectors their number and the sums of their components. A task sends one row a cluster."""
    dims, k = centroids.shape[1], len(centroids)

    def run(batches):
        count, total = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            column = batch.column("v")
            cluster, _, x, apart = _assign(column, centroids, order)
            for own in np.unique(cluster).tolist():
                rows = cluster == own
                count[own] += int(rows.sum())
                total[own] = [a + b for a, b in zip(total[own], x[rows].sum(axis=0).tolist())]
            for row, exact in apart.items():
                total[cluster[row]] = [a + int(b) for a, b in zip(total[cluster[row]], exact[0])]
        there = [i for i in range(k) if count[i]]
        big = pa.list_(pa.decimal128(38, 0))
        yield pa.record_batch({"cluster": pa.array(there, pa.int32()), "n": pa.array([count[i] for i in there], pa.int64()), "sums": pa.array([total[i] for i in there], big)})

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    found = {}
    for r in rows:  # clusters x dimensions
        found.setdefault(r.cluster, (r.n, [0] * dims))[1][r.dim] = int(r.total)
    return found


def scaled(vector: Column, dims: int, scale: int) -> Column:
    """scale * x as doubles of a vector that has `dims` components, none of them null or not finite; else null."""
    v = vector.cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(v, lambda x: x * float(scale)))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia and centroid (array of decimal) of every vector that takes part.

    Those are the rows of exactly `dims` components, none null or not finite; a component x counts as floor(scale * x). Centroids start as the k of
    them with the least sha256(seed:id), in that order (ties, as of repeated ids: by components; a null id counts as the empty text). A round assigns
    each vector to its nearest centroid by squared distance (ties: the smaller number) and replaces each centroid that has vectors by floor(sum/count);
    after the last, vectors are assigned once more. Repeated rows count each. With fewer than k vectors there are as many centroids; an empty table
    gives an empty result. Other columns don't matter. A distance or inertia beyond 64 bits is an error.

    A round is one scan that sends a row a cluster and task, and the driver holds k centroids. The assignment is written once, as its sums are
    needed beside its rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    kept = vectors.select(quoted(id_col).alias("id"), scaled(quoted(vector_col), dims, scale).alias("v")).where(F.col("v").isNotNull())
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(digest.alias("digest"), "v").orderBy("digest", F.transform("v", lambda x: F.floor(x)), "v").limit(k).collect()
    schema = f"id {kind}, cluster int, distance long"
    if not start:
        empty = spark.createDataFrame([], schema).withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid": F.array().cast("array<decimal(38,0)>")})
        return empty.withColumnRenamed("id", id_col)
    centroids = np.array([[int(np.floor(x)) for x in r.v] for r in start], object)
    spread = kept.agg(*[F.var_pop(F.col("v")[d]).alias(f"d{d}") for d in range(dims)]).first()
    order = sorted(range(dims), key=lambda d: (-spread[d], d))  # affects the work alone, not the result
    for _ in range(rounds):
        for own, (n, total) in _sums(kept, centroids, order).items():
            centroids[own] = [t // n for t in total]

    def assign(batches):
        for batch in batches:
            cluster, distance, _, _ = _assign(batch.column("v"), centroids, order)
            yield pa.record_batch({"id": batch.column("id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    assigned = Scratch(spark, "centroids").keep(kept.mapInArrow(assign, schema), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), [str(int(x)) for x in centroids[c]]) for c, s in sorted(inertia.items())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>")  # k rows
    out = assigned.join(F.broadcast(known), "cluster").withColumn("centroid", F.col("centroid").cast("array<decimal(38,0)>"))
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertia and digest of the final centroid of every vector of 64 components."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    out = []
    for r in range(rounds + 1):
        out.append(f"""
d{r} AS (SELECT i, k, CAST(sum((q.x - c.x) * (q.x - c.x)) AS BIGINT) AS dist FROM q JOIN c{r} c USING (dim) GROUP BY i, k),
b{r} AS (SELECT i, min({{'dist': dist, 'k': k}}) AS b FROM d{r} GROUP BY i),
a{r} AS (SELECT i, b.k AS k, b.dist AS dist FROM b{r})""")
        if r < rounds:
            out.append(f"""
m{r} AS (SELECT k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN q USING (i) GROUP BY k, dim),
c{r + 1} AS (SELECT c.k, c.dim, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.dim = m.dim)""")
    return ",".join(out)


OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: 64 * CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS (SELECT i, unnest(range(64)) AS dim, CAST(floor(unnest(e)) AS BIGINT) AS x FROM v),
s AS (SELECT i, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), list_transform(e, lambda x: floor(x))) - 1 AS k FROM v),
c0 AS (SELECT k, dim, x FROM s JOIN q USING (i) WHERE k < 16), {_rounds_sql(3)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN v USING (i) JOIN h USING (k)
"""
