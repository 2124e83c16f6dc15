"""Centroid clustering of integer vectors: distances by blocked matrix products, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block of the matrix product.
BLOCK = 4096
#: Integers up to this are exact in float64, and so are sums and products that stay below it.
EXACT = 2.0**53
#: Above any long: a distance beyond is given as null.
LONG = 1 << 63


def integer_vectors(df: DataFrame, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<double>) of the rows that take part: exactly dim components, none null, not
    a number or infinite; not yet scaled."""
    x = F.col(vector_col).cast("array<double>")
    fit = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x")).where(fit)


def _block(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) as float64: exact at any size where scale is a power of two. Python
    integers where a product is beyond float64."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.isfinite(scaled).all():
        return scaled
    out = np.empty(x.shape, object)
    out.flat = [int(v) * scale if abs(v) > EXACT else int(np.floor(v * scale)) for v in x.flat]
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Float64 integers of any size as Python integers."""
    out = np.empty(x.shape, object)
    out.flat = [int(v) for v in x.flat]
    return out


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties to the smaller number.

    |x|^2 - 2 x.c + |c|^2 with the product by BLAS. Every term and partial sum of the three is
    an integer of magnitude at most dim (max|x| + max|c|)^2; below 2^53 float64 has each of
    them exactly, in whatever order BLAS adds. Other blocks subtract and square in Python
    integers, which have no bound.
    """
    most = max(max((abs(v) for v in c), default=0) for c in centroids) + int(abs(x).max(initial=0))
    if x.dtype != object and x.shape[1] * most**2 < EXACT:
        c = np.array(centroids, np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    exact, at, best = _whole(x), np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        d = ((exact - np.array(c, object)) ** 2).sum(axis=1)
        if best is None:
            best = d
        else:
            less = (d < best).astype(bool)
            at[less], best[less] = k, d[less]
    return at, best


def sums_of(x: np.ndarray, at: np.ndarray, k: int) -> list[int]:
    """Exact sum of the rows of x in cluster k, in Python integers."""
    rows = x[at == k]
    if x.dtype != object and len(rows) * int(abs(rows).max(initial=0)) < EXACT:
        return [int(v) for v in rows.sum(axis=0)]
    return list(_whole(rows).sum(axis=0))


def _add(a: list | None, b: list | None) -> list | None:
    """Sums of two parts: a list for each cluster of count, inertia and component sums."""
    if a is None or b is None:
        return a or b
    return [[u + v for u, v in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def _totals(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Per cluster [count, inertia, component sums...] over all vectors: each task adds up its
    blocks, and treeAggregate adds up the tasks, so that neither the driver nor one task gets
    more than a few parts of one small size."""
    dim, n = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 2) for _ in range(n)]
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _block(b.column(0).slice(at, BLOCK), dim, scale)
                near, far = nearest(x, centroids)
                own = [[int((near == k).sum()), int(sum(far[near == k].tolist())), *sums_of(x, near, k)] for k in range(n)]
                total = _add(total, own)
        yield pa.RecordBatch.from_pydict({"t": [";".join(",".join(map(str, p)) for p in total)]})

    def read(so_far: list | None, row) -> list | None:
        return _add(so_far, [[int(v) for v in p.split(",")] for p in row["t"].split(";")])

    return vectors.select("x").mapInArrow(run, "t string").rdd.treeAggregate(None, read, _add, depth=3) or [[0] * (dim + 2) for _ in range(n)]


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int, scale: int) -> list[list[int]]:
    """The k vectors of least lowercase-hex sha256 of `seed:id`, in that order (a null id counts
    as empty text; ties by the components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, "x").limit(k).collect()
    return [[int(v) for v in _block(pa.array([r["x"]]), dim, scale)[0]] for r in rows]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """(assigned, centroids, inertia by cluster) after `rounds` rounds of exact integer k-means.

    Rows take part if they have exactly dim components, none null or non-finite; scale is a
    power of two. Repeated rows count each. With fewer than k rows each is a centroid; an empty
    table gives no rows and no centroids. Other columns of df are not read.

    assigned: id, cluster int, distance long (squared; null where a long can't hold it).
    Every round is one pass over the written vectors; k times (dim + 2) integers come back.
    """
    vectors = written(integer_vectors(df, dim, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, seed, dim, scale)
    if not centroids:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), [], []
    for _ in range(rounds):
        totals = _totals(vectors, centroids, scale)
        centroids = [[v // t[0] for v in t[2:]] if t[0] else c for t, c in zip(totals, centroids, strict=True)]
    inertia = [t[1] for t in _totals(vectors, centroids, scale)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                near, far = nearest(_block(part.column(1), dim, scale), centroids)
                d = pa.array([v if v < LONG else None for v in map(int, far)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near.astype(np.int32)), d], [id_col, "cluster", "distance"])

    assigned = vectors.mapInArrow(run, f"`{id_col}` bigint, cluster int, distance bigint")
    return assigned, centroids, inertia


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster over all of `embeddings`, with the sums of squared distances (null where a long
    can't hold one) and a hash of each row's final centroid."""
    assigned, centroids, inertia = cluster(table(spark, sf_dir, "embeddings"))
    held = lambda v: v if v < LONG else None
    rows = [(k, held(v), ",".join(map(str, c))) for k, (v, c) in enumerate(zip(inertia, centroids, strict=True))]
    by = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, c string").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    # One row a cluster, k at most.
    return assigned.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(held(sum(inertia))).cast("bigint").alias("inertia"), "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """One table of centroids for each round: assignments by the least (distance, number), then
    componentwise floor of the mean."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    assign = "SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}}) AS m FROM v, c{0} GROUP BY r"
    for t in range(rounds):
        parts.append(f"a{t} AS MATERIALIZED ({assign.format(t)})")
        parts.append(f"e{t} AS (SELECT m.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{t}, range(1, {dim + 1}) AS w(i) GROUP BY ALL)")
        parts.append(f"m{t} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM e{t} GROUP BY k)")
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))")
    parts.append(f"z AS ({assign.format(rounds)})")
    last = f"SELECT vec_id, m.k::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.k)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON k = m.k"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
