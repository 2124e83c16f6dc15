"""Feature tables: denoised covariance, principal components, meta-label models over purged
folds, and feature importances. Rows stay in Spark; what reaches the driver has the size of
features squared, or of folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import kept
from .splits import cpcv_ranges, fold_bounds


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred sums of products) of numeric columns, null and NaN as 0: one pass
    for the means and one in which each task adds up X'X of its batches about them; the tasks'
    matrices are summed entry by entry in Spark."""
    x = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    clean, p = df.select(*x), len(columns)
    first = clean.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = first["n"]
    if not n:
        return 0, np.zeros(p), np.zeros((p, p))
    mean = np.array([first[f"m{i}"] for i in range(p)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            part = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) - mean
            total += part.T @ part
        yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]})

    cells = clean.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(p * p)
    for r in cells:
        out[r["i"]] = r["v"]
    return n, mean, out.reshape(p, p)


def _descending(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors, each with its largest component positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def denoised_covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, raw, denoised) for every pair of columns: sample covariance of the columns
    standardised by their population deviations (1 where that is 0), before and after the
    eigenvalues below the Marcenko-Pastur bound (1 + sqrt(columns / rows))^2 are all set to
    their mean. Fewer than two rows give no result rows."""
    spark = df.sparkSession
    n, _, g = gram(df, columns)
    schema = "a string, b string, raw double, denoised double"
    if n < 2:
        return spark.createDataFrame([], schema)
    sd = np.sqrt(np.diag(g) / n)
    sd[sd == 0] = 1.0
    raw = g / np.outer(sd, sd) / (n - 1)
    values, vectors = _descending(raw)
    noise = values < (1 + math.sqrt(len(columns) / n)) ** 2
    kept = np.where(noise, values[noise].mean() if noise.any() else 0.0, values)
    clean = (vectors * kept) @ vectors.T
    return spark.createDataFrame([(a, b, float(raw[i, j]), float(clean[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], schema)


def principal_components(df: DataFrame, columns: list[str], share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(rows with pc1, pc2, ... in place of the columns, table of component, eigenvalue, ratio,
    cumulative) of as many components as explain more than `share` of the variance. A
    component's sign makes its largest loading positive. Null and NaN count as 0."""
    n, mean, g = gram(df, columns)
    values, vectors = _descending(g / max(n - 1, 1))
    values = np.maximum(values, 0.0)
    total = values.sum() or 1.0
    cumulative = np.cumsum(values / total)
    k = min(len(columns), int(np.searchsorted(cumulative, share, side="right")) + 1)
    x = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) - float(m) for c, m in zip(columns, mean, strict=True)]
    found = [sum((v * float(w) for v, w in zip(x[1:], vectors[1:, i], strict=True)), x[0] * float(vectors[0, i])).alias(f"pc{i + 1}") for i in range(k)]
    table = df.sparkSession.createDataFrame([(i + 1, float(values[i]), float(values[i] / total), float(cumulative[i])) for i in range(k)], "component int, eigenvalue double, ratio double, cumulative double")
    return df.select(*[c for c in df.columns if c not in columns], *found), table


def forest(columns: list[str], label: str = "label", weight: str | None = None, trees: int = 100, depth: int = 5, leaf: int = 5, seed: int = 42, per_split: str = "auto"):
    """(assembler, classifier): a random forest on a vector of the columns."""
    kind = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, featureSubsetStrategy=per_split, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y")
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip"), kind.setWeightCol(weight) if weight else kind


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds _w: rows over twice the rows of the row's label (0 or 1)."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p")).first()
    ones, zeros = max(n["p"] or 0, 1), max(n["n"] - (n["p"] or 0), 1)
    return df.withColumn("_w", F.when(F.col(label) == 1, n["n"] / (2.0 * ones)).otherwise(n["n"] / (2.0 * zeros)))


def scored(df: DataFrame, label: str = "label", p: str = "p") -> list[Column]:
    """Aggregates of a fold: log loss, precision, recall and F1 at .5 (0 where undefined)."""
    y, q = F.col(label), F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = (F.col(p) > 0.5).cast("double")
    tp, said, true = F.sum(hit * y), F.sum(hit), F.sum(y)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), zero(F.try_divide(tp, said)).alias("precision"), zero(F.try_divide(tp, true)).alias("recall"), zero(F.try_divide(2 * tp, said + true)).alias("f1"), F.avg(y).alias("pos_rate_test")]


def _clean(df: DataFrame, columns: list[str], label: str, *others: str) -> DataFrame:
    """The columns that a model needs as a written table, as fitting reads it many times: label
    and features as doubles, null and NaN features as 0."""
    x = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    return kept(df.select(*others, F.col(label).cast("double").alias(label), *x), "features")


def meta_labels(df: DataFrame, columns: list[str], folds: int = 6, tests: int = 2, embargo: float = 0.01, idx: str = "idx", until: str = "until", label: str = "label", **model) -> dict:
    """A meta-label forest over combinatorial purged folds of labelled rows: idx numbers them in
    time from 0, `until` is the idx at which a row's label is known.

    A fold trains on rows outside its test ranges whose label is known before a range starts, or
    that come later than its end by `embargo` of all rows. Returns `folds` (fold, train_size,
    test_size, log_loss, precision, recall, f1, pos_rate_train, pos_rate_test), `predictions`
    (idx, p: of the last fold that tests a row), `importance` (feature, mean, sd over folds) and
    `model`, fitted on all rows. One fit a fold; only its metrics and importances come back."""
    spark, df = df.sparkSession, _clean(df, columns, label, idx, until)
    total = df.count()
    bounds = fold_bounds(total, folds)
    ranges: dict[int, list[tuple[int, int]]] = {}
    for r in cpcv_ranges(spark, total, folds, tests, bounds=bounds).where("role = 'test'").collect():
        ranges.setdefault(r["split_id"], []).append((r["lo"], r["hi"]))
    rest, rows, shares, predictions = int(total * embargo), [], [], None
    assembler, kind = forest(columns, label, "_w", **model)
    data = assembler.transform(df)
    none = F.lit(False)
    for k, parts in sorted(ranges.items()):
        inside, near = none, none
        for lo, hi in parts:
            inside = inside | ((F.col(idx) >= lo) & (F.col(idx) < hi))
            near = near | ((F.col(idx) < hi + rest) & (F.col(until) >= lo))
        train, test = balanced(data.where(~near), label), data.where(inside)
        fitted = kind.fit(train)
        seen = fitted.transform(test).select(idx, label, vector_to_array("_p")[1].alias("p"), F.lit(k).alias("fold"))
        size = train.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("r")).first()
        got = seen.agg(F.count(F.lit(1)).alias("n"), *scored(seen, label)).first()
        rows.append((k, size["n"], got["n"], *[float(got[c]) for c in ("log_loss", "precision", "recall", "f1")], float(size["r"]), float(got["pos_rate_test"])))
        shares.append(fitted.featureImportances.toArray())
        predictions = seen if predictions is None else predictions.unionByName(seen)
    spread = np.array(shares)
    return {
        "folds": spark.createDataFrame(rows, "fold int, train_size long, test_size long, log_loss double, precision double, recall double, f1 double, pos_rate_train double, pos_rate_test double"),
        "predictions": predictions.groupBy(idx).agg(F.max_by("p", "fold").alias("p")),
        "importance": spark.createDataFrame([(c, float(m), float(s)) for c, m, s in zip(columns, spread.mean(axis=0), spread.std(axis=0, ddof=1) if len(spread) > 1 else spread[0] * 0, strict=True)], "feature string, mean double, sd double"),
        "model": kind.fit(balanced(data, label)),
    }


def importance_mdi(df: DataFrame, columns: list[str], label: str = "label", **model) -> DataFrame:
    """(feature, importance): mean decrease of impurity of a forest that sees one feature a split."""
    assembler, kind = forest(columns, label, per_split="1", **model)
    fitted = kind.fit(assembler.transform(_clean(df, columns, label)))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, fitted.featureImportances.toArray(), strict=True)], "feature string, importance double")


def importance_mda(df: DataFrame, columns: list[str], id_: str, label: str = "label", repeats: int = 5, seed: int = 42, **model) -> DataFrame:
    """(feature, mean, sd): how much a forest's accuracy falls when a feature's values are dealt to
    other rows, over `repeats` shuffles. A shuffle is a rotation within groups of about a
    thousand rows that a hash of the distinct id puts together, in hash order: each row gets the
    features of the next row of its group. Every row is scored once for each feature, with that
    one exchanged."""
    assembler, kind = forest(columns, label, per_split="1", **model)
    data = _clean(df, columns, label, id_)
    fitted = kind.fit(assembler.transform(data))
    groups = max(1, data.count() // 1000)
    parts = []
    for k in range(repeats):
        h = F.xxhash64(F.lit(seed + k), id_)
        w = Window.partitionBy("_g").orderBy("_h", id_)
        own = F.array(*columns)
        rows = data.withColumn("_h", h).withColumn("_g", F.pmod(F.col("_h"), F.lit(groups))).withColumn("_own", own)
        rows = rows.withColumn("_other", F.coalesce(F.lead("_own").over(w), F.first("_own").over(w)))
        rows = rows.select(label, "_own", "_other", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("_j"))
        mixed = rows.select(label, "_j", *[F.when(F.col("_j") == j, F.col("_other")[j]).otherwise(F.col("_own")[j]).alias(c) for j, c in enumerate(columns)])
        right = fitted.transform(assembler.transform(mixed)).groupBy("_j").agg(F.avg((F.col("_y") == F.col(label)).cast("double")).alias("a"))
        parts.append(right.withColumn("_k", F.lit(k)))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    base = got.where("_j = -1").select("_k", F.col("a").alias("_b"))
    names = F.array(*map(F.lit, columns))
    falls = got.where("_j >= 0").join(F.broadcast(base), "_k").groupBy("_j").agg(F.avg(F.col("_b") - F.col("a")).alias("mean"), F.stddev_pop(F.col("_b") - F.col("a")).alias("sd"))
    return falls.select(names[F.col("_j")].alias("feature"), "mean", "sd")
