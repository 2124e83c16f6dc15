"""Purged combinatorial splits, paths, walk-forward, islands. Split tables are small
relations (split_id, idx range, role); data is joined to them by range."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fold_bounds(total: int, folds: int) -> list[tuple[int, int]]:
    """Half-open bounds of equal folds; the last takes the rest."""
    size = total // folds
    return [(i * size, total if i == folds - 1 else (i + 1) * size) for i in range(folds)]


def cpcv_ranges(spark: SparkSession, total: int, folds: int, tests: int, purge: int = 1, embargo: int = 0, bounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(split_id, folds array, role, lo, hi) for every choice of `tests` folds, keyed by the
    fold set; train is what lies outside the test folds, `purge` before and `embargo` after
    each. `bounds`: folds of another kind than equal ones."""
    bounds, rows = bounds or fold_bounds(total, folds), []
    for k, chosen in enumerate(combinations(range(folds), tests)):
        rows += [(k, list(chosen), "test", *bounds[c]) for c in chosen]
        out = sorted((bounds[c][0] - purge, bounds[c][1] + embargo) for c in chosen)
        at = 0
        for lo, hi in [*out, (total, total)]:
            if lo > at:
                rows.append((k, list(chosen), "train", at, min(lo, total)))
            at = max(at, hi)
    return spark.createDataFrame(rows, "split_id int, folds array<int>, role string, lo long, hi long")


def backtest_paths(spark: SparkSession, folds: int, tests: int) -> DataFrame:
    """(path_id, fold, split_id): the path of a fold's n-th split is n."""
    pairs = [(f, k) for k, chosen in enumerate(combinations(range(folds), tests)) for f in chosen]
    df = spark.createDataFrame(pairs, "fold int, split_id int")
    return df.withColumn("path_id", F.row_number().over(Window.partitionBy("fold").orderBy("split_id")) - 1)


def path_rows(df: DataFrame, by: str, folds: int, tests: int) -> DataFrame:
    """The rows of df (ordered by the numeric column `by`) in every backtest path: df's columns,
    path_id, fold, split_id. A row's fold comes from the index of its value's first row, so that
    rows of one value share a fold; the table of paths has tests times C(folds, tests) / folds
    rows a fold."""
    total = df.count()
    bounds = fold_bounds(total, folds)
    at = runs(df, by).select(F.col(by).alias("_by"), F.size(F.filter(F.array(*[F.lit(lo) for lo, _ in bounds[1:]]), lambda lo: lo <= F.col("start"))).alias("fold"))
    placed = df.join(at, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    return placed.join(F.broadcast(backtest_paths(df.sparkSession, folds, tests)), "fold")


def runs(df: DataFrame, by: str) -> DataFrame:
    """(by, start, n): each value of the numeric column `by`, nulls last, with its number of
    rows and the 0-based index of its first row in that order. Ranges of values are summed
    apart and offset by the rows before them, a table of one row a range; their bounds are
    fixed values, so that every evaluation deals alike."""
    one = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = one.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)])).first()[0]
    cuts = sorted(set(cuts or []))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(by))) if cuts else F.lit(0)
    one = one.withColumn("_part", F.when(F.col(by).isNull(), len(cuts) + 1).otherwise(below))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = one.groupBy("_part").agg(F.sum("n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("start", F.sum("n").over(within) - F.col("n")).join(F.broadcast(offsets), "_part")
    return one.select(by, (F.col("start") + F.col("_offset")).alias("start"), "n")


def assign(rows: DataFrame, ranges: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows in the ranges that hold them. The ranges table is a few rows a split."""
    return rows.join(F.broadcast(ranges), (F.col(idx) >= F.col("lo")) & (F.col(idx) < F.col("hi"))).drop("lo", "hi")


def sizes(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(folds, role, n): rows in each range, of runs of rows rather than single ones."""
    lo, hi = F.greatest("lo", "start"), F.least("hi", F.col("start") + F.col("n"))
    both = runs.join(F.broadcast(ranges), (F.col("start") < F.col("hi")) & (F.col("start") + F.col("n") > F.col("lo")))
    return both.groupBy("folds", "role").agg(F.sum(hi - lo).alias("n"))


def leakage(assigned: DataFrame, idx: str = "idx") -> DataFrame:
    """(split_id, shared): indexes that are both train and test; all 0 in a sound split."""
    both = assigned.groupBy("split_id", idx).agg(F.countDistinct("role").alias("n"))
    return both.groupBy("split_id").agg(F.sum((F.col("n") > 1).cast("long")).alias("shared"))


def walk_forward(total: int, folds: int, anchored: bool = True, gap: int = 0) -> list[tuple[int, str, int, int]]:
    """(split_id, role, lo, hi): train on what precedes each later fold."""
    bounds, out = fold_bounds(total, folds), []
    for i in range(1, folds):
        out.append((i - 1, "train", 0 if anchored else bounds[i - 1][0], max(0, bounds[i][0] - gap)))
        out.append((i - 1, "test", *bounds[i]))
    return out


def purged_folds(total: int, folds: int, purge: int = 1, embargo: int = 7) -> list[tuple[int, str, int, int]]:
    """(split_id, role, lo, hi): each fold is once the test, train what lies outside it, the
    `purge` rows before and the `embargo` rows after."""
    out = []
    for k, (lo, hi) in enumerate(fold_bounds(total, folds)):
        out.append((k, "test", lo, hi))
        out += [(k, "train", a, b) for a, b in ((0, lo - purge), (hi + embargo, total)) if b > a]
    return out


def hold_out(total: int, share: float = 0.7, gap: int = 0) -> list[tuple[int, str, int, int]]:
    """One split: the first `share` of the rows trains, what follows the gap tests."""
    cut = int(total * share)
    return [(0, role, a, b) for role, a, b in (("train", 0, cut), ("test", cut + gap, total)) if b > a]


def anchored(total: int, folds: int = 3, share: float = 0.2, gap: int = 0) -> list[tuple[int, str, int, int]]:
    """Walk-forward with an expanding train part: the last `share` of each fold tests on all
    that precedes it by the gap; folds without a train part are left out."""
    out, size = [], total // folds
    for k in range(folds):
        hi = (k + 1) * size
        lo = hi - int(size * share)
        if lo - gap > 0 and hi > lo:
            out += [(k, "train", 0, lo - gap), (k, "test", lo, hi)]
    return out


def two_sided(total: int, folds: int, tests: int, share: float = 0.01) -> list[tuple[int, tuple, str, int, int]]:
    """(split_id, folds, role, lo, hi) of combinatorial splits whose train ranges keep `share`
    of all rows away on both sides of every test fold."""
    bounds, pad, out = fold_bounds(total, folds), int(total * share), []
    for k, chosen in enumerate(combinations(range(folds), tests)):
        out += [(k, chosen, "test", *bounds[c]) for c in chosen]
        for f in sorted(set(range(folds)) - set(chosen)):
            lo, hi = bounds[f]
            lo, hi = lo + pad * (f - 1 in chosen), hi - pad * (f + 1 in chosen)
            if hi > lo:
                out.append((k, chosen, "train", lo, hi))
    return out


def adaptive_bounds(rows: DataFrame, idx: str, feature: str, folds: int, parts: int = 3, low: float = 0.25, high: float = 0.75) -> list[tuple[int, int]]:
    """Fold bounds that follow a feature of rows numbered 0..n-1: each inner border of equal
    folds, made of `parts` pieces each, moves one piece later where the feature is below its
    `low` quantile there, one piece earlier where it is above its `high` one. Then the
    smallest folds are merged, or the largest halved, until there are `folds`. One
    aggregation; only the rows at the borders reach the driver."""
    q = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile(feature, low).alias("a"), F.percentile(feature, high).alias("b")).first()
    total, pieces = q["n"], folds * parts
    at = [round(i * total / pieces) for i in range(pieces)]
    inner = list(range(parts, pieces, parts))
    value = dict(rows.where(F.col(idx).isin([at[b] for b in inner])).select(idx, feature).collect())
    moved = [min(pieces - 1, max(1, b + (value[at[b]] < q["a"]) - (value[at[b]] > q["b"]))) for b in inner]
    cuts = [0, *sorted({at[b] for b in moved} - {0, total}), total]
    while len(cuts) - 1 > folds:
        size = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        del cuts[max(1, size.index(min(size)))]
    while len(cuts) - 1 < folds:
        size = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        k = size.index(max(size))
        cuts.insert(k + 1, (cuts[k] + cuts[k + 1]) // 2)
    return list(zip(cuts, cuts[1:], strict=False))


def bagged(ranges: DataFrame, bags: int = 5, seed: int = 1943) -> DataFrame:
    """Each split once for each bag, with the bag's seed."""
    one = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: F.struct(b.alias("bag"), (b + seed).alias("seed"))))
    return ranges.withColumn("_b", one).select(*ranges.columns, "_b.bag", "_b.seed")


def coverage(assigned: DataFrame, total: int, idx: str = "idx") -> DataFrame:
    """One row: indexes that no split tests, and the least and most often one is tested."""
    times = assigned.where("role = 'test'").groupBy(idx).agg(F.count(F.lit(1)).alias("n"))
    return times.agg((F.lit(total) - F.count(F.lit(1))).alias("untested"), F.min("n").alias("least"), F.max("n").alias("most"))


def purge_by_time(train: DataFrame, tests: DataFrame, embargo: str = "0 days") -> DataFrame:
    """Rows (t, t1: when their label is known) that train beside test periods (t, t1; a few
    rows): those whose label is known before a period starts, or which come later than its
    last label by the embargo. Periods are merged to runs first; each row meets the runs by
    two comparisons in a broadcast anti join."""
    bad = (F.col("t1") >= F.col("_from")) & (F.col("t") <= F.col("_to") + F.expr(f"INTERVAL {embargo}"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    runs = tests.withColumn("_m", F.max("t1").over(w)).withColumn("_g", F.coalesce((F.col("t") > F.col("_m")).cast("int"), F.lit(0)))
    runs = runs.withColumn("_r", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_r").agg(F.min("t").alias("_from"), F.max("t1").alias("_to"))
    return train.join(F.broadcast(runs), bad, "left_anti")


def islands(df: DataFrame, idx: str, key: str = "symbol") -> DataFrame:
    """(key, lo, hi, n): runs of consecutive integers."""
    w = Window.partitionBy(key).orderBy(idx)
    return df.withColumn("_g", F.col(idx) - F.row_number().over(w)).groupBy(key, "_g").agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_g")


def even_bounds(total: int, folds: int) -> list[tuple[int, int]]:
    """Half-open bounds of folds of nearly equal size; the first ones take the rest, one each."""
    size, rest = divmod(total, folds)
    ends = [0]
    for i in range(folds):
        ends.append(ends[-1] + size + (i < rest))
    return list(zip(ends[:-1], ends[1:], strict=True))


def embargoed_folds(df: DataFrame, t: str, known: str, folds: int, share: float) -> DataFrame:
    """df's rows with fold and role for every fold: test, the rows of one of `folds` even folds in
    the order of the numeric time t (rows of one time stay together in the fold of the first);
    train, other rows whose label, known at time `known`, lies before the fold's first time less
    an embargo or after its last time plus it. The embargo is `share` of the fold's time span.
    A row meets the few folds by a generated array."""
    bounds = even_bounds(df.count(), folds)
    starts = F.array(*[F.lit(lo) for lo, _ in bounds[1:]])
    at = runs(df, t).select(F.col(t).alias("_t"), F.size(F.filter(starts, lambda lo: lo <= F.col("start"))).alias("_own"))
    rows = df.join(at, F.col(t).eqNullSafe(F.col("_t"))).drop("_t")
    spans = rows.groupBy(F.col("_own").alias("fold")).agg(F.min(t).alias("_from"), F.max(t).alias("_to"))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(F.broadcast(spans), "fold")
    rest = (F.col("_to") - F.col("_from")) * share
    apart = (F.col(known) < F.col("_from") - rest) | (F.col(known) > F.col("_to") + rest)
    role = F.when(F.col("_own") == F.col("fold"), "test").when(apart, "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").drop("_own", "_from", "_to")


def rolling_windows(train: int, trade: int, length: int) -> list[tuple[int, str, int, int]]:
    """(window, role, lo, hi) over train + trade dates in order: each window trades the next
    `length` dates (the last what is left) and trains on the `train` dates before them."""
    length, out = max(1, min(length, trade)), []
    for k, lo in enumerate(range(train, train + trade, length)):
        out += [(k, "train", lo - train, lo), (k, "trade", lo, min(lo + length, train + trade))]
    return out


def split_by(df: DataFrame, method: str, t: str, known: str | None = None, folds: int = 5, **options) -> DataFrame:
    """(split_id, role, lo, hi) row ranges in the order of t by name of the method: holdout,
    walk_forward, purged, cpcv. Options are those of the method's own function."""
    total, spark = df.count(), df.sparkSession
    if method == "cpcv":
        return cpcv_ranges(spark, total, folds, **{"tests": 2, **options}).select("split_id", "role", "lo", "hi")
    if method == "walk_forward":
        rows = walk_forward(total, folds, **options)
    elif method == "purged":
        bounds = even_bounds(total, folds)
        purge, embargo = options.get("purge", 1), options.get("embargo", 0)
        rows = [(k, "test", lo, hi) for k, (lo, hi) in enumerate(bounds)]
        rows += [(k, "train", a, b) for k, (lo, hi) in enumerate(bounds) for a, b in ((0, lo - purge), (hi + embargo, total)) if b > a]
    elif method == "holdout":
        cut = int(total * (1 - options.get("share", 0.2)))
        rows = [(0, "train", 0, cut), (0, "test", cut, total)]
    else:
        raise ValueError(f"method: {method}")
    return spark.createDataFrame(rows, "split_id int, role string, lo long, hi long")
