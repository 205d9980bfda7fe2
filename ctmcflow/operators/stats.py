"""Statistics for tables of any length: ranks by range partitions, leave-one-out by closed form, resampling by joins.

Nothing gathers a column in one task: sums of products are small aggregates, the rank of a value is its place in
its range partition plus the sizes of the partitions before.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ctmcflow.session import Scratch


def ranks(scratch: Scratch, df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds rn (1.., by value then key) and rank (ties averaged) over the whole table; value must not be null."""
    spread = df.repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    spread = scratch.put(spread, "ranged")  # equal values share a partition
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n"))
    # one row per partition
    before = sizes.withColumn("_off", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).fillna(0).select("_p", "_off")
    j = spread.join(F.broadcast(before), "_p")
    w, t = Window.partitionBy("_p").orderBy(value, key), Window.partitionBy("_p").orderBy(value)
    ties = df.groupBy(value).agg(F.count("*").alias("_ties"))
    j = j.join(ties, value)
    return j.withColumn("rn", F.col("_off") + F.row_number().over(w)).withColumn("rank", F.col("_off") + F.rank().over(t) + (F.col("_ties") - 1) / 2.0).drop("_p", "_off", "_ties")


def kruskal(ranked: DataFrame, group: str) -> DataFrame:
    """H with tie correction, eta squared, and the exact p of three groups (chi square with 2 degrees): one row."""
    g = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    t = ranked.groupBy("rank").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    s = g.agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).crossJoin(t)
    n = F.col("N").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    s = s.withColumn("h", h)
    return s.select(F.col("N").alias("n"), "k", "h", F.greatest(F.lit(0.0), F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k"))).alias("eta2"), F.when(F.col("k") == 3, F.exp(-F.col("h") / 2)).alias("p"))


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation per group: ``by`` columns, n, q0, q1, .. in the order of ``probs``.

    Nulls and NaN do not count; groups without values do not come out. Distinct values are range-partitioned by group and
    value, the place of a value is its place in its partition plus the group's rows in the partitions before, so no group
    and no column meets in one task.
    """
    scratch, by = scratch or Scratch(df.sparkSession, "quantiles"), by or []
    v = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    c = v.groupBy(*by, "_v").agg(F.count("*").alias("_n")).repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id())
    c = scratch.put(c, "ranged")
    sizes = c.groupBy(*by, "_p").agg(F.sum("_n").alias("_s"))
    # a row per group and partition it lies in
    w = Window.partitionBy(*by).orderBy("_p") if by else Window.orderBy("_p")
    before = sizes.withColumn("_off", F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.groupBy(*by).agg(F.sum("_s").alias("n"))
    # null is a group like any other
    rename = lambda d: d.select(*[F.col(b).alias(f"_{b}") for b in by], *[x for x in d.columns if x not in by])
    b4, tt = rename(before.drop("_s").withColumnRenamed("_p", "_q")), rename(total)
    j = c.join(b4, [F.col("_p") == F.col("_q")] + [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]).drop("_q", *[f"_{b}" for b in by])
    j = j.join(tt, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]).drop(*[f"_{b}" for b in by]) if by else j.crossJoin(F.broadcast(tt))  # one row
    hi = F.col("_off") + F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_v"))
    j = j.withColumn("_hi", hi).withColumn("_lo", F.col("_hi") - F.col("_n"))
    at = [(F.lit(float(p)) * (F.col("n") - 1)) for p in probs]
    hit = lambda x: F.max(F.when((F.col("_lo") <= x) & (x < F.col("_hi")), F.col("_v")))
    g = j.groupBy(*by, "n").agg(*[x for i, a in enumerate(at) for x in (hit(F.floor(a)).alias(f"_f{i}"), hit(F.ceil(a)).alias(f"_c{i}"))])
    return g.select(*by, "n", *[(F.col(f"_f{i}") + (a - F.floor(a)) * (F.col(f"_c{i}") - F.col(f"_f{i}"))).alias(f"q{i}") for i, a in enumerate(at)])


def places(df: DataFrame, value: str, by: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Adds place (0, 1, ..) and n: where a row stands in its group by ``value``, which must be unique in it, and the group's rows.

    Rows are range-partitioned by group and value, as in ``quantiles``; ``by`` must not be null.
    """
    scratch = scratch or Scratch(df.sparkSession, "places")
    c = scratch.put(df.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = c.groupBy(*by, "_p").agg(F.count("*").alias("_s"))
    before = sizes.withColumn("_off", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    j = c.join(before, [*by, "_p"]).join(sizes.groupBy(*by).agg(F.sum("_s").alias("n")), by)
    return j.withColumn("place", F.col("_off") + F.row_number().over(Window.partitionBy(*by, "_p").orderBy(value)) - 1).drop("_p", "_off")


def mann_whitney(df: DataFrame, value: str, group: str, scratch: Scratch | None = None) -> DataFrame:
    """U, rank-biserial correlation 1 - 2U/(n1 n2), z and ties (sum of t^3 - t) for each pair of groups, from value counts.

    Groups are a handful of classes, a column each. Distinct values are range-partitioned; how many values of a group lie below
    comes from running counts in a partition plus the sums of the partitions before. Pairs of values are never built, and no
    task sees the whole column. Empty tables give no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "mw")
    names = sorted(r[0] for r in df.select(group).distinct().limit(101).collect() if r[0] is not None)
    if len(names) > 100:
        raise ValueError("Mann-Whitney tests of all pairs are for at most 100 groups")
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "g1 string, g2 string, n1 long, n2 long, u double, ties double, rank_biserial double, z double")
    count = [F.count_if(F.col(group) == x).alias(f"_n{i}") for i, x in enumerate(names)]
    c = df.groupBy(value).agg(*count).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    c = scratch.put(c, "ranged")
    sizes = c.groupBy("_p").agg(*[F.sum(f"_n{i}").alias(f"_s{i}") for i in range(len(names))])
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("_p", *[F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    below = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    j = c.join(F.broadcast(before), "_p")
    j = j.withColumns({f"_b{i}": F.col(f"_o{i}") + F.coalesce(F.sum(f"_n{i}").over(below), F.lit(0)) for i in range(len(names))})
    n = lambda i: F.col(f"_n{i}").cast("double")
    sums = [F.sum(f"_n{i}").alias(f"n{i}") for i in range(len(names))]
    for a, b in pairs:
        t = n(a) + n(b)
        sums += [F.sum(n(a) * (F.col(f"_b{b}") + n(b) / 2.0)).alias(f"u{a}_{b}"), F.sum(t * t * t - t).alias(f"t{a}_{b}")]
    one = j.agg(*sums)
    rows = [F.struct(F.lit(names[a]).alias("g1"), F.lit(names[b]).alias("g2"), F.col(f"n{a}").alias("n1"), F.col(f"n{b}").alias("n2"), F.col(f"u{a}_{b}").alias("u"), F.col(f"t{a}_{b}").alias("ties")) for a, b in pairs]
    u = one.select(F.inline(F.array(*rows)))
    m = F.col("n1").cast("double") * F.col("n2")
    return u.withColumn("rank_biserial", 1 - 2 * F.col("u") / m).withColumn("z", (F.col("u") - m / 2) / F.sqrt(m * (F.col("n1") + F.col("n2") + 1) / 12))


def mann_whitney_p(tests: DataFrame, small: int = 8) -> DataFrame:
    """Adds p, two-sided: exact where the smaller group has at most ``small`` values and nothing is tied, else normal with the
    correction for ties and half a unit of U."""
    m, n = F.col("n1").cast("double") * F.col("n2"), (F.col("n1") + F.col("n2")).cast("double")
    var = m / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = F.try_divide(F.abs(F.col("u") - m / 2) - 0.5, F.sqrt(var))
    normal = F.least(F.lit(1.0), two_sided(F.greatest(z, F.lit(0.0))))
    few = (F.least("n1", "n2") <= small) & (F.col("ties") == 0)
    return tests.withColumn("p", F.when(few, F.pandas_udf(_exact_u, "double")("n1", "n2", "u")).otherwise(normal))


def _exact_u(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Exact two-sided p of untied U, from the number of orders with each U (a handful of rows, groups of a few values)."""
    out = []
    for a, b, x in zip(n1, n2, u):
        a, b = int(min(a, b)), int(max(a, b))
        if a > 8:
            out.append(None)  # this row takes the normal p
            continue
        # orders of i values of the one and j of the other: the last is one of the second (U unchanged) or of the first (all j count)
        ways = [np.ones(1) for _ in range(b + 1)]
        for _ in range(a):
            new = [ways[0]]
            for j in range(1, b + 1):
                lift = np.r_[np.zeros(j), ways[j]]
                low = np.r_[new[j - 1], np.zeros(len(lift) - len(new[j - 1]))] if len(new[j - 1]) < len(lift) else new[j - 1]
                new.append(low + np.r_[lift, np.zeros(len(low) - len(lift))])
            ways = new
        p = ways[b] / ways[b].sum()
        out.append(min(1.0, 2 * float(p[int(round(max(x, a * b - x))) :].sum())))
    return pd.Series(out)


def _products(xs: list[str], y: str) -> list[Column]:
    """Sums of products of the columns (the first being ones) and the target, as aggregates."""
    cols = [F.lit(1.0), *map(F.col, xs)]
    d = len(cols)
    out = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    return out + [F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(cols)] + [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")]


def _matrices(r, d: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    return g, np.array([r[f"b{i}"] or 0.0 for i in range(d)]), r["yy"] or 0.0, r["n"]


def gram(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, sum y^2, sum y and the number of rows, the first column being ones; one aggregate."""
    g, b, yy, n = _matrices(df.agg(*_products(xs, y)).first(), len(xs) + 1)
    return g, b, yy, b[0], n


def descend(g: np.ndarray, b: np.ndarray, n: int, alpha: float, l1: float, steps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Coefficients that minimise |y - Xw|^2 / 2n + alpha (l1 |w| + (1 - l1) w^2 / 2), the intercept free, from sums of products."""
    w = np.zeros(len(b))
    g, b = g / max(1, n), b / max(1, n)
    for _ in range(steps):
        far = 0.0
        for j in range(len(w)):
            rho, cost = b[j] - g[j] @ w + g[j, j] * w[j], alpha * (j > 0)
            below = g[j, j] + cost * (1 - l1)
            new = np.sign(rho) * max(0.0, abs(rho) - cost * l1) / below if below > 0 else 0.0
            far = max(far, abs(new - w[j]))
            w[j] = new
        if far < tol:
            break
    return w


def penalised(df: DataFrame, xs: list[str], y: str, key: str, models: dict[str, tuple[list[float], list[float]]], folds: int = 5) -> list[tuple]:
    """Lasso and elastic-net models by k-fold cross-validation: (model, alpha, l1, r2, rmse, n, nonzero).

    models: name -> (alphas, l1 ratios). Where several are given, each outer fold chooses among them by the inner
    folds, and the model of all rows by all folds. The table is read once: rows are put in folds by a hash of the key,
    and all fits and all held-out errors come from the folds' sums of products. Rows with a null must not be given. An
    empty table gives models of zeros with null metrics.
    """
    d = len(xs) + 1
    rows = df.groupBy(F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold")).agg(*_products(xs, y)).collect()  # one per fold
    parts = [_matrices(r, d) for r in rows]

    def total(*out: int):
        keep = [p for i, p in enumerate(parts) if i not in out] or [(np.zeros((d, d)), np.zeros(d), 0.0, 0)]
        return tuple(sum(p[i] for p in keep) for i in range(4))

    def error(w: np.ndarray, part) -> float:
        g, b, yy, _ = part
        return max(0.0, float(yy - 2 * w @ b + w @ g @ w))

    def fitted(params: tuple[float, float], *out: int) -> np.ndarray:
        g, b, _, n = total(*out)
        return descend(g, b, n, *params)

    def choose(grid: list, *out: int):
        if len(grid) == 1:
            return grid[0]
        return min(grid, key=lambda m: (sum(error(fitted(m, *out, i), p) for i, p in enumerate(parts) if i not in out), -m[0]))

    g, b, yy, n = total()
    spread = yy - b[0] ** 2 / n if n else 0.0
    found = []
    for name, (alphas, ratios) in models.items():
        grid = [(float(a), float(r)) for a in alphas for r in ratios]
        best = choose(grid)
        sse = sum(error(fitted(choose(grid, i), i), p) for i, p in enumerate(parts))
        w = descend(g, b, n, *best)
        found.append((name, *best, float(1 - sse / spread) if spread > 0 else None, math.sqrt(sse / n) if n else None, n, int((np.abs(w[1:]) > 1e-10).sum())))
    return found


# Coefficients of the rational approximation of the error function (absolute error under 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_SCALE = 0.3275911


def two_sided(z: Column) -> Column:
    """p of a standard normal being at least as far from zero as z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_SCALE * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + F.lit(c)) * t
    return poly * F.exp(-x * x)


def _inverse(g: np.ndarray, alpha: float) -> np.ndarray:
    penalty = alpha * np.eye(len(g))
    penalty[0, 0] = 0.0
    return np.linalg.pinv(g + penalty)


def loo(df: DataFrame, xs: list[str], y: str, alpha: float = 0.0) -> DataFrame:
    """Adds pred (of all rows) and loo (prediction without the row itself) for a linear model with ridge alpha."""
    g, b, *_ = gram(df, xs, y)
    inv = _inverse(g, alpha)
    beta = inv @ b
    cols = [F.lit(1.0), *map(F.col, xs)]
    pred = sum((F.lit(float(w)) * c for w, c in zip(beta, cols)), F.lit(0.0))
    lever = sum((F.lit(float(inv[i, j])) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
    out = df.withColumn("pred", pred).withColumn("_h", lever)
    return out.withColumn("loo", F.col(y) - F.try_divide(F.col(y) - F.col("pred"), 1 - F.col("_h"))).drop("_h")


def metrics(y: str, p: str) -> list[Column]:
    """R^2, RMSE and MAE of predictions as aggregates."""
    e, Y = F.col(y) - F.col(p), F.col(y)
    return [(1 - F.try_divide(F.sum(e * e), F.var_pop(Y) * F.count(Y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(Y).alias("n")]


def loo_penalised(df: DataFrame, xs: list[str], y: str, models: dict[str, tuple[float, float]]) -> DataFrame:
    """Leave-one-out metrics of lasso and elastic-net models (name -> alpha, share of the absolute penalty): model, r2, rmse, mae, n.

    Each row is fitted without itself from the sums of products of all rows less its own, in the task that holds it.
    """
    g, b, _, _, n = gram(df, xs, y)
    names = list(models)

    def run(batches):
        for pdf in batches:
            x = np.c_[np.ones(len(pdf)), pdf[xs].to_numpy(float)]
            t, out = pdf[y].to_numpy(float), []
            for r, v in zip(x, t):
                gi, bi = g - np.outer(r, r), b - r * v
                out.append((v, *[float(r @ descend(gi, bi, n - 1, *models[m])) for m in names]))
            yield pd.DataFrame(out, columns=["_y", *[f"_{i}" for i in range(len(names))]])

    p = df.select(*xs, y).mapInPandas(run, "_y double, " + ", ".join(f"_{i} double" for i in range(len(names))))
    long = p.select("_y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{i}").alias("_loo")) for i, m in enumerate(names)])))
    return long.groupBy("model").agg(*metrics("_y", "_loo"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom."""
    return F.pandas_udf(_student, "double")(t, df)


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p, by the continued fraction of the incomplete beta function."""

    def beta_share(x: float, a: float, b: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_share(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        # evaluated from its tail: terms d1 = -(a+m)(a+b+m)x / ((a+2m)(a+2m+1)), d2 = m(b-m)x / ((a+2m-1)(a+2m))
        f = 1.0
        for m in range(400, -1, -1):
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            f = 1 + odd / f
            if m:
                f = 1 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / f
        return front / f

    return pd.Series([None if pd.isna(v) or k <= 0 else beta_share(k / (k + v * v), k / 2, 0.5) for v, k in zip(t, df)], dtype="float64")


def forward_selection(df: DataFrame, xs: list[str], y: str, most: int = 4, drop: float = 0.01) -> list[tuple[int, str, float]]:
    """Greedy choice by leave-one-out R^2; the step that loses more than ``drop`` is the last.

    One aggregate gives the sums of products of all regressors; a step scores all its candidates in one more pass.
    """
    g, b, *_ = gram(df, xs, y)
    chosen: list[str] = []
    history: list[tuple[int, str, float]] = []
    best = -math.inf
    while len(chosen) < min(most, len(xs)):
        open_ = [x for x in xs if x not in chosen]
        aggs = []
        for k, x in enumerate(open_):
            use = [*chosen, x]
            at = [0, *[1 + xs.index(c) for c in use]]
            inv = _inverse(g[np.ix_(at, at)], 0.0)
            beta, cols = inv @ b[at], [F.lit(1.0), *map(F.col, use)]
            pred = sum((F.lit(float(w)) * c for w, c in zip(beta, cols)), F.lit(0.0))
            lever = sum((F.lit(float(inv[i, j])) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
            e = F.try_divide(F.col(y) - pred, 1 - lever)
            aggs.append((1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias(f"r{k}"))
        row = df.agg(*aggs).first()
        score, x = max((row[f"r{k}"] if row[f"r{k}"] is not None else -math.inf, x) for k, x in enumerate(open_))
        history.append((len(history) + 1, x, score))
        if score < best - drop:
            break
        chosen.append(x)
        best = max(best, score)
    return history


BLOCK = 250  # replicates in one job: their copies of the rows are never there all at once


def blocks(times: int) -> list[tuple[int, int]]:
    return [(i, min(times, i + BLOCK)) for i in range(0, times, BLOCK)]


def shuffled(indexed: DataFrame, n: int, times: int, column: str, seed: int = 42, part: tuple[int, int] | None = None) -> DataFrame:
    """Every row ``times`` times with rep and s_<column>: the column of another row, by an affine map of the dense index rn.

    The maps rn -> (a rn + b) mod n with a prime to n are permutations, so each replicate is one equi-join. With part,
    only the replicates from part[0] up to part[1] come out.
    """
    rng = np.random.default_rng(seed)
    maps = []
    while len(maps) < times:
        a = int(rng.integers(1, max(2, n)))
        if math.gcd(a, n) == 1:
            maps.append((len(maps), a, int(rng.integers(0, max(1, n)))))
    m = indexed.sparkSession.createDataFrame(maps[slice(*part)] if part else maps, "rep int, _a long, _b long")
    other = indexed.select((F.col("rn") - 1).alias("_to"), F.col(column).alias(f"s_{column}"))
    j = indexed.crossJoin(F.broadcast(m)).withColumn("_to", (F.col("_a") * (F.col("rn") - 1) + F.col("_b")) % F.lit(max(1, n)))  # ``times`` replicates
    return j.join(other, "_to").drop("_to", "_a", "_b")


def r2_of(g: np.ndarray, b: np.ndarray, yy: float, n: int) -> float:
    ss = yy - b[0] * b[0] / max(n, 1)
    return float(1 - (yy - b @ np.linalg.pinv(g) @ b) / ss) if ss > 0 else float("nan")


def permutation_test(indexed: DataFrame, xs: list[str], y: str, times: int = 1000) -> dict:
    """R^2 of the linear model against ``times`` permutations of y: observed, p = (#null >= observed + 1) / (times + 1)."""
    g, b, yy, _, n = gram(indexed, xs, y)
    if not n:
        return {"observed": None, "p": None, "n": 0, "times": 0}
    cols = [F.lit(1.0), *map(F.col, xs)]
    sums = [F.sum(c * F.col(f"s_{y}")).alias(f"b{i}") for i, c in enumerate(cols)]
    rows = [r for part in blocks(times) for r in shuffled(indexed, n, times, y, part=part).groupBy("rep").agg(*sums).collect()]
    seen = r2_of(g, b, yy, n)
    null = [r2_of(g, np.array([r[f"b{i}"] for i in range(len(cols))]), yy, n) for r in rows]
    return {"observed": seen, "p": (sum(x >= seen for x in null) + 1) / (len(null) + 1), "n": n, "times": len(null)}


def bootstrap(df: DataFrame, xs: list[str], y: str, key: str, times: int = 2000) -> DataFrame:
    """Percentile interval of R^2: rows weigh Poisson(1) times in each replicate, by a hash of key and replicate."""
    u = F.pmod(F.xxhash64(key, "rep"), F.lit(1 << 30)) / float(1 << 30)
    cum, acc, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):
        cum += acc
        weight = weight + (u >= cum).cast("int")
        acc /= k + 1
    cols = [F.lit(1.0), *map(F.col, xs)]
    aggs = [F.sum(F.col("_w") * cols[i] * cols[k]).alias(f"g{i}_{k}") for i in range(len(cols)) for k in range(i, len(cols))]
    aggs += [F.sum(F.col("_w") * c * F.col(y)).alias(f"b{i}") for i, c in enumerate(cols)] + [F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("yy"), F.sum("_w").alias("n")]
    rows = []
    for low, high in blocks(times):
        reps = df.sparkSession.range(low, high).withColumnRenamed("id", "rep")
        rows += df.crossJoin(F.broadcast(reps)).withColumn("_w", weight.cast("double")).groupBy("rep").agg(*aggs).collect()
    out = []
    for r in rows:
        d = len(cols)
        g = np.array([[r[f"g{min(i, k)}_{max(i, k)}"] for k in range(d)] for i in range(d)])
        out.append(r2_of(g, np.array([r[f"b{i}"] for i in range(d)]), r["yy"], r["n"]))
    out = [x for x in out if x == x]
    low, mid, high = np.percentile(out, [2.5, 50, 97.5]) if out else (None, None, None)
    return df.sparkSession.createDataFrame([(*(None if v is None else float(v) for v in (low, mid, high)), len(out))], "low double, median double, high double, n_boot long")
