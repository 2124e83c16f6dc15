"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit
table scans and exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors that the fit takes at most, those of the least hash.
SAMPLE_ROWS = 20_000
#: Rows of a data block and queries of a query block, on average.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Candidates of a block that are reranked for each query, at first.
RERANK = 48
#: Cells that a query visits at least, where there are as many.
LEAST_PROBE = 24
#: Queries that probe and rerank are measured on, those of the least hash.
TRIAL_QUERIES = 256
#: Shares of the trial's true neighbours that must lie in probed cells, and be found in all.
CELL_RECALL, RECALL = 0.985, 0.975


class AnisotropicIndex:
    """Coarse cells and a product code of 16 centroids (4 bits) for every two dimensions.

    The code of a unit vector x minimises |r|^2 + (eta - 1) <r, x>^2 over its residual r:
    an error parallel to x changes large inner products most, and eta > 1 penalises it.
    """

    def __init__(self, sample: np.ndarray, n: int, threshold: float = 0.2, seed: int = 7, cells: int | None = None):
        d = sample.shape[1]
        self.dim, self.pad = d, -d % 4
        self.m = (d + self.pad) // 2
        self.eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        x = self._wide(sample)
        self.cells = self._kmeans(sample, max(1, min(2048, len(sample) // 8, cells or round(n**0.5 / 4))), rng)
        parts = x.reshape(len(x), self.m, 2)
        self.books = np.stack([self._centroids(parts[:, j], rng) for j in range(self.m)])
        for _ in range(4):
            codes = self._assign(parts, 1)
            self._update(parts, codes)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad)))

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
        centre = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            at = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(1), axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, at, x)
            count = np.bincount(at, minlength=k)[:, None]
            centre = np.where(count > 0, total / np.maximum(count, 1), centre)
        return centre

    def _centroids(self, x: np.ndarray, rng) -> np.ndarray:
        k = min(16, len(x))
        return np.concatenate([self._kmeans(x, k, rng), np.zeros((16 - k, 2))])

    def _assign(self, parts: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent over the subspaces: each picks the centroid that lowers the
        whole vector's loss, given the parallel error of the others."""
        n = len(parts)
        codes = np.stack([np.argmin(((parts[:, j, None] - self.books[j]) ** 2).sum(2), axis=1) for j in range(self.m)], 1)
        rows = np.arange(n)
        par = np.stack([(parts[:, j] * (parts[:, j] - self.books[j][codes[:, j]])).sum(1) for j in range(self.m)], 1)
        total = par.sum(1)
        for _ in range(sweeps):
            for j in range(self.m):
                r = parts[:, j, None] - self.books[j]
                own = (parts[:, j, None] * r).sum(2)
                rest = total - par[:, j]
                loss = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + own) ** 2
                codes[:, j] = np.argmin(loss, axis=1)
                par[:, j] = own[rows, codes[:, j]]
                total = rest + par[:, j]
        return codes

    def _update(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Each centroid solves its 2 x 2 system, given the others' parallel error."""
        par = np.stack([(parts[:, j] * (parts[:, j] - self.books[j][codes[:, j]])).sum(1) for j in range(self.m)], 1)
        total = par.sum(1)
        for j in range(self.m):
            x, rest = parts[:, j], total - par[:, j]
            for c in np.unique(codes[:, j]):
                on = codes[:, j] == c
                xs = x[on]
                left = len(xs) * np.eye(2) + (self.eta - 1) * xs.T @ xs
                right = xs.sum(0) + (self.eta - 1) * (xs * (rest[on] + (xs**2).sum(1))[:, None]).sum(0)
                self.books[j][c] = np.linalg.solve(left, right)
            par[:, j] = (x * (x - self.books[j][codes[:, j]])).sum(1)
            total = rest + par[:, j]

    def cell(self, x: np.ndarray, most: int = 1) -> np.ndarray:
        near = x @ self.cells.T - 0.5 * (self.cells**2).sum(1)
        most = min(most, len(self.cells))
        part = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(self.cells) else np.broadcast_to(np.arange(len(self.cells)), near.shape)
        return part

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte."""
        codes = self._assign(self._wide(x).reshape(len(x), self.m, 2)).astype(np.uint8)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each code byte adds to the inner product."""
        parts = self._wide(q).reshape(len(q), self.m, 2)
        one = np.einsum("qmd,mkd->qmk", parts, self.books)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), self.m // 2, 256).astype(np.float32)


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Original vectors in double precision, and their unit forms."""
    x = np.array(list(vectors), np.float64)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _truth(placed: DataFrame, ids: np.ndarray, unit: np.ndarray, k: int) -> pd.DataFrame:
    """(q, cell, score): the k nearest of all of `placed` for each trial query, by brute force.
    A task holds BLOCK_ROWS rows and k neighbours a query at a time."""
    shared = placed.sparkSession.sparkContext.broadcast((ids, unit))

    def run(frames):
        own, q = shared.value
        score, cell = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int32)
        for pdf in frames:
            for at in range(0, len(pdf), BLOCK_ROWS):
                rows = pdf.iloc[at : at + BLOCK_ROWS]
                here = q @ _unit(rows["v"])[1].T
                here[own[:, None] == rows["vec_id"].to_numpy()] = -np.inf
                score = np.hstack([score, here])
                cell = np.hstack([cell, np.broadcast_to(rows["cell"].to_numpy(np.int32), here.shape)])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        at, j = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"q": at.astype(np.int32), "cell": cell[at, j], "score": score[at, j]})

    got = placed.select("vec_id", "v", "cell").mapInPandas(run, "q int, cell int, score double")
    got = got.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell")))
    return got.where(F.col("_n") <= k).drop("_n").toPandas()


def ann_search(vectors: DataFrame, queries: DataFrame, k: int = 5, probe: int | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """The k rows of `vectors` of largest cosine that the index finds for each row of
    `queries` (same columns), its own id left out.

    Returns query_id long, rank int (from 1), vec_id long, score double (exact cosine of
    the original vectors in double precision), nearest first, ties to the smaller id. Null
    and zero vectors, vectors with null or non-finite components, vectors of another length
    than the sample's most frequent one and null ids take no part. All candidates, if fewer
    than k. Repeated rows with one id count once, by their nearest vector; a repeated query asks
    with its least vector. No vectors: an empty result.

    Of rows with the same vector only the k + 1 of least id can be among anybody's k
    nearest; a grouped limit, which Spark applies before its shuffle, leaves those, so that
    copies cost nothing. Rows fall into coarse cells, cells into blocks of bounded size; a
    query visits the blocks of its `probe` nearest cells, in query blocks of bounded size.
    Every block is one task's work: four-bit table scan, then exact rerank of its best rows.
    The index (`cells` cells or by size, codebooks) is fitted on at most `sample_rows` rows on
    the driver.

    Without `probe`, it is measured: of TRIAL_QUERIES of the queries, brute force over all
    rows tells how many cells hold CELL_RECALL of the true neighbours (LEAST_PROBE at least, up
    to all cells), and the rows reranked are doubled until the search itself finds RECALL of them.
    """
    spark = vectors.sparkSession
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    pick = lambda df: df.where(fine).where(good).select(F.col(id_col).cast("long").alias("vec_id"), (F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")).alias("v"))
    base = pick(vectors)
    same = Window.partitionBy("v").orderBy("vec_id")
    base = written(base.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"), "ann-vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = base.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    if not sample:
        return empty
    lens = pd.Series([len(r["v"]) for r in sample]).mode()
    dim = int(lens[0])
    n = base.count()
    index = AnisotropicIndex(_unit([r["v"] for r in sample if len(r["v"]) == dim])[1], n, cells=cells)
    shared = spark.sparkContext.broadcast(index)

    def to_cells(most: int):
        def run(frames):
            for pdf in frames:
                if len(pdf):
                    cell = shared.value.cell(_unit(pdf["v"])[1], most)
                    yield pdf.assign(cell=list(cell.astype(np.int32)))

        return run

    def to_codes(frames):
        for pdf in frames:
            for at in range(0, len(pdf), BLOCK_ROWS):
                rows = pdf.iloc[at : at + BLOCK_ROWS]
                unit = _unit(rows["v"])[1]
                yield rows.assign(cell=shared.value.cell(unit)[:, 0].astype(np.int32), code=[c.tobytes() for c in shared.value.encode(unit)])

    # The index: each vector's cell and code, made once; searches read them.
    placed = written(base.where(F.size("v") == dim).mapInPandas(to_codes, f"vec_id long, v {kind}, cell int, code binary"), "ann-index")
    asked = pick(queries).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    if probe is not None:
        return _search(placed, asked.mapInPandas(to_cells(probe), f"vec_id long, v {kind}, cell array<int>"), shared, k, RERANK)
    trial = asked.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(TRIAL_QUERIES).toPandas()
    if not len(trial):
        return empty
    probe, rerank = _measured(placed, trial, shared, k)
    return _search(placed, asked.mapInPandas(to_cells(probe), f"vec_id long, v {kind}, cell array<int>"), shared, k, rerank)


def _measured(placed: DataFrame, trial: pd.DataFrame, shared, k: int) -> tuple[int, int]:
    """(probe, rerank) of which the trial queries find RECALL of their true neighbours."""
    index, unit = shared.value, _unit(trial["v"])[1]
    true = _truth(placed, trial["vec_id"].to_numpy(), unit, k)
    if not len(true):
        return 1, RERANK
    order = np.argsort(-(unit @ index.cells.T - 0.5 * (index.cells**2).sum(1)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[true["q"], true["cell"]]
    probe = max(LEAST_PROBE, int(np.sort(place)[int(np.ceil(CELL_RECALL * len(place))) - 1]) + 1)
    least = pd.Series(true.groupby("q")["score"].min().to_numpy(), trial["vec_id"].to_numpy()[np.unique(true["q"])])
    spark = placed.sparkSession
    rows = [(int(i), list(map(float, v)), c.tolist()) for i, v, c in zip(trial["vec_id"], trial["v"], index.cell(unit, probe).astype(int), strict=True)]
    asked = written(spark.createDataFrame(rows, "vec_id long, v array<double>, cell array<int>"), "ann-trial")
    largest = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    rerank = RERANK
    while rerank < largest:
        got = _search(placed, asked, shared, k, rerank).select("query_id", "score").toPandas()
        # By score, so that of equally near rows any counts.
        if (got["score"] >= got["query_id"].map(least) - 1e-9).sum() >= RECALL * len(true):
            break
        rerank *= 2
    return probe, rerank


def _search(placed: DataFrame, asked: DataFrame, shared, k: int, rerank: int) -> DataFrame:
    """The search itself: rows with their cell, queries with the array of their cells."""
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "v", F.explode("cell").alias("cell")), "ann-queries")
    # Cells are at most 2048: what is broadcast has that bound.
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("q")), "cell")
    blocks = F.broadcast(counts.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nb"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("qb")))
    data = placed.join(blocks, "cell").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    data = data.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("cell", "b", "c", "vec_id", "v", "code")
    ask = asked.join(blocks, "cell").withColumn("c", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int"))
    ask = ask.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("cell", "b", "c", "query_id", "v")

    def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows.sort_values("vec_id", kind="stable")
        x = np.array(list(rows["v"]), np.float64)
        q, q_unit = _unit(asks["v"])
        ids, own = rows["vec_id"].to_numpy(), asks["query_id"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        x_len, q_len = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        found, most = [], min(len(ids), rerank)
        for at in range(0, len(q), 64):
            lut = shared.value.tables(q_unit[at : at + 64])
            near = np.zeros((len(lut), len(ids)), np.float32)
            for j in range(codes.shape[1]):
                near += lut[:, j].take(codes[:, j], axis=1)
            for i in range(len(lut)):
                top = np.argpartition(-near[i], most - 1)[:most] if most < len(ids) else np.arange(len(ids))
                top = top[ids[top] != own[at + i]]
                score = x[top] @ q[at + i] / (x_len[top] * q_len[at + i])
                best = np.lexsort((ids[top], -score))[:k]
                found.append((np.full(len(best), own[at + i]), ids[top][best], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    keys = ["cell", "b", "c"]
    got = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_search over all of `embeddings`; queries: vec_id divisible by 50; 5 nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
