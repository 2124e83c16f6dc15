"""Affine recurrences y[t] = a[t] y[t-1] + b[t] within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import slice_cuts, slice_of

#: Rows of a chunk.
CHUNK = 4096


def affine_scan(df: DataFrame, a: str, b: str, out: str, key: str = "symbol", order: str = "ts", descending: bool = False, cuts: list | None = None) -> DataFrame:
    """Adds y[t] = a[t] y[t-1] + b[t], y before the first row being 0 (give the seed as the
    first row's b). Null a or b count as a = 1, b = 0 (the state stays).

    Affine maps compose, so that a group is cut into slices of time and those into chunks of
    CHUNK rows. A chunk folds its rows into one map; the maps of a slice's chunks are composed
    in order, and so are the maps of a group's slices; each chunk then replays its rows from
    its entry state. Rows are numbered within a slice only. A task sorts one slice of a group,
    and no array is longer than a chunk's rows, a slice's chunks or a group's slices, each
    composed by one pass. cuts: machines.slice_cuts of the same rows, where a caller has them
    (finding them is a pass over the rows).
    """
    return affine_scans(df, [(a, b, out)], key, order, descending, cuts)


def affine_scans(df: DataFrame, series: list[tuple[str, str, str]], key: str = "symbol", order: str = "ts", descending: bool = False, cuts: list | None = None) -> DataFrame:
    """affine_scan of several series (a, b, out) at once: one sort and one dealing of the rows."""
    by = F.col(order).desc() if descending else F.col(order)
    cuts = slice_cuts(df, order) if cuts is None else cuts
    place = slice_of(order, cuts)
    df = df.withColumn("__slice", -place if descending else place)
    df = df.withColumn("__row", F.row_number().over(Window.partitionBy(key, "__slice").orderBy(by)) - 1)
    own = [c for c in df.columns if c not in (key, "__row", "__slice")]
    maps = []
    for k, (a, b, _) in enumerate(series):
        maps += [F.coalesce(F.col(a), F.lit(1.0)).cast("double").alias(f"a{k}"), F.when(F.col(a).isNull(), 0.0).otherwise(F.coalesce(F.col(b), F.lit(0.0))).cast("double").alias(f"b{k}")]
    values = F.struct(F.col("__row"), *maps, F.struct(*own).alias("r"))
    rows = F.array_sort(F.collect_list(values), lambda x, y: x["__row"] - y["__row"])
    chunks = df.withColumn("__chunk", F.floor(F.col("__row") / CHUNK).cast("int")).groupBy(key, "__slice", "__chunk").agg(rows.alias("rows"))
    for k in range(len(series)):
        chunks = chunks.withColumn(f"m{k}", F.expr(f"aggregate(rows, named_struct('a', 1.0D, 'b', 0.0D), (s, x) -> named_struct('a', s.a * x.a{k}, 'b', x.a{k} * s.b + x.b{k}))"))
    if cuts:
        entry = _entries(chunks, key, len(series))
        chunks = chunks.join(entry.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__s")) & (F.col("__chunk") == F.col("__c"))).drop("__key", "__s", "__c")
    else:
        before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        for k in range(len(series)):
            chunks = chunks.withColumn(f"y{k}", F.aggregate(F.collect_list(f"m{k}").over(before), F.lit(0.0), lambda y, x: x["a"] * y + x["b"]))
    found = [F.expr(_walk(k)).alias(f"y{k}") for k in range(len(series))]
    flat = chunks.select(key, F.explode(F.arrays_zip("rows", *found)).alias("z"))
    return flat.select(key, "z.rows.r.*", *[F.col(f"z.y{k}").alias(out) for k, (_, _, out) in enumerate(series)])


def _walk(k: int, small: int = 64) -> str:
    """The states of series k after each of a chunk's rows. Appending copies an array, so that
    the rows are replayed in pieces of `small`."""
    step = f"x.a{k} * s.y + x.b{k}"
    piece = f"aggregate(part, named_struct('y', t.y, 'o', cast(array() as array<double>)), (s, x) -> named_struct('y', {step}, 'o', concat(s.o, array({step}))), s -> s.o)"
    pieces = f"transform(sequence(0, cast(floor((size(rows) - 1) / {small}) as int)), k -> slice(rows, k * {small} + 1, {small}))"
    return f"flatten(aggregate({pieces}, named_struct('y', y{k}, 'o', cast(array() as array<array<double>>)), (t, part) -> named_struct('y', aggregate(part, t.y, (s, x) -> x.a{k} * s + x.b{k}), 'o', concat(t.o, array({piece}))), t -> t.o))"


def _prefixes(items: Column) -> Column:
    """Of maps {k, m} in order: an array of {k, p}, the composition p of all maps before each,
    and last one with k null, that of all."""
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    then = lambda p, m: F.struct((p["a"] * m["a"]).alias("a"), (m["a"] * p["b"] + m["b"]).alias("b"))
    empty = F.array().cast("array<struct<k:int,p:struct<a:double,b:double>>>")
    walked = F.aggregate(items, F.struct(none.alias("p"), empty.alias("o")), lambda s, x: F.struct(then(s["p"], x["m"]).alias("p"), F.concat(s["o"], F.array(F.struct(x["k"].alias("k"), s["p"].alias("p")))).alias("o")))
    return F.transform(F.array(walked), lambda w: F.concat(w["o"], F.array(F.struct(F.lit(None).cast("int").alias("k"), w["p"].alias("p")))))[0]


def _entries(chunks: DataFrame, key: str, n: int) -> DataFrame:
    """(key, __s, __c, y0, y1, ...): the states in which each chunk is entered. Slices have at
    most SLICE / CHUNK chunks or so, groups at most MOST_SLICES slices."""
    listed = lambda of, m: _prefixes(F.array_sort(F.collect_list(F.struct(F.col(of).alias("k"), m.alias("m")))))
    per = chunks.groupBy(key, F.col("__slice").alias("__s")).agg(*[listed("__chunk", F.col(f"m{k}")).alias(f"w{k}") for k in range(n)])
    whole = per.groupBy(key).agg(*[listed("__s", F.element_at(f"w{k}", -1)["p"]).alias(f"v{k}") for k in range(n)])
    starts = whole.select(F.col(key).alias("__g"), F.explode(F.arrays_zip(*[f"v{k}" for k in range(n)])).alias("x")).select("__g", F.col("x.v0.k").alias("__t"), *[F.col(f"x.v{k}.p.b").alias(f"__y{k}") for k in range(n)])
    at = per.select(key, "__s", F.explode(F.arrays_zip(*[f"w{k}" for k in range(n)])).alias("x")).where("x.w0.k IS NOT NULL")
    at = at.join(starts, F.col(key).eqNullSafe(F.col("__g")) & (F.col("__s") == F.col("__t")))
    return at.select(key, "__s", F.col("x.w0.k").alias("__c"), *[(F.col(f"x.w{k}.p.a") * F.col(f"__y{k}") + F.col(f"x.w{k}.p.b")).alias(f"y{k}") for k in range(n)])


def ema(df: DataFrame, x: str, span: int, out: str, alpha: float | None = None, **kw) -> DataFrame:
    """Exponential mean seeded with the first value; alpha = 2 / (span + 1)."""
    alpha = 2 / (span + 1) if alpha is None else alpha
    order = kw.get("order", "ts")
    first = F.row_number().over(Window.partitionBy(kw.get("key", "symbol")).orderBy(order)) == 1
    df = df.withColumn("_a", F.when(first, 0.0).otherwise(1 - alpha)).withColumn("_b", F.when(first, F.col(x)).otherwise(F.col(x) * alpha))
    return affine_scan(df, "_a", "_b", out, **kw).drop("_a", "_b")


def wilder(df: DataFrame, x: str, n: int, out: str, **kw) -> DataFrame:
    return ema(df, x, n, out, alpha=1 / n, **kw)


def kama(df: DataFrame, x: str, n: int, out: str, fast: int = 2, slow: int = 30, strict: bool = False) -> DataFrame:
    """Kaufman's adaptive mean: y moves towards x by the square of a smoothing constant that
    the efficiency ratio, net over summed moves of n rows, sets between slow and fast. It
    starts from the first value with as many rows as there are; strict: it starts from row
    n's value, null before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    i = F.row_number().over(w)
    df = df.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w))).withColumn("_i", i)
    net = F.abs(F.col(x) - F.first(x).over(w.rowsBetween(-n, 0)))
    er = F.coalesce(F.try_divide(net, F.sum("_d").over(w.rowsBetween(-(n - 1), 0))), F.lit(0.0))
    df = df.withColumn("_k", F.pow(er * (f - s) + s, 2))
    seed = n if strict else 1
    df = df.withColumn("_a", F.when(F.col("_i") <= seed, 0.0).otherwise(1 - F.col("_k"))).withColumn("_b", F.when(F.col("_i") <= seed, F.col(x)).otherwise(F.col(x) * F.col("_k")))
    got = affine_scan(df.drop("_d", "_k"), "_a", "_b", out)
    return got.withColumn(out, F.when(F.col("_i") >= seed, F.col(out))).drop("_a", "_b", "_i")


def discounted_return(df: DataFrame, reward: str, undone: str, out: str, gamma: float = 0.99, key: str = "symbol", order: str = "ts") -> DataFrame:
    """G[t] = r[t] + gamma * undone[t] * G[t+1], backwards in time, 0 beyond the end."""
    df = df.withColumn("_a", F.lit(gamma) * F.col(undone)).withColumn("_b", F.col(reward).cast("double"))
    return affine_scan(df, "_a", "_b", out, key=key, order=order, descending=True).drop("_a", "_b")


def advantage(df: DataFrame, reward: str, undone: str, value: str, out: str, gamma: float = 0.99, lam: float = 0.95, key: str = "symbol", order: str = "ts", bootstrap: float = 0.0) -> DataFrame:
    """Generalised advantage: A[t] = d[t] + gamma lam undone[t] A[t+1], with
    d[t] = r[t] + gamma undone[t] V[t+1] - V[t] and V beyond the end `bootstrap`."""
    after = F.coalesce(F.lead(value).over(Window.partitionBy(key).orderBy(order)), F.lit(bootstrap))
    df = df.withColumn("_b", F.col(reward) + gamma * F.col(undone) * after - F.col(value)).withColumn("_a", F.lit(gamma * lam) * F.col(undone))
    return affine_scan(df, "_a", "_b", out, key=key, order=order, descending=True).drop("_a", "_b")
