"""Filling missing values with a mixture of Gaussian and categorical parts, fitted by EM on all rows.

Every row is a vector of numbers (some missing) and categories (some missing). A component has a
full-covariance Gaussian over the numbers and one distribution per category. The E-step runs inside
tasks on Arrow batches, handles each pattern of missing numbers by conditioning, and emits
sufficient statistics of a size that depends on the model only; Spark adds them up by position and
the driver sees that one vector per iteration. Missing numbers become conditional
expectations, missing categories the mode; every fill is marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ctmcflow.session import Scratch

COMPONENTS = 24
ITERATIONS = 15
INIT_ROWS = 2000  # only the starting point is drawn from a sample; EM itself reads every row


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    cats: list[np.ndarray] = field(default_factory=list)
    center: np.ndarray | None = None
    scale: np.ndarray | None = None


def start(x: np.ndarray, levels: list[int], k: int, center: np.ndarray, scale: np.ndarray, seed: int = 7) -> Mixture:
    rng = np.random.default_rng(seed)
    z = np.where(np.isfinite(x), (x - center) / scale, 0.0)
    if not len(z):
        z = np.zeros((1, x.shape[1]))
    at = [z[rng.integers(len(z))]]
    for _ in range(k - 1):
        d = np.min([((z - a) ** 2).sum(1) for a in at], axis=0)
        at.append(z[rng.choice(len(z), p=d / d.sum())] if d.sum() else z[rng.integers(len(z))])
    d = x.shape[1]
    cats = [np.full((k, n), 1.0 / n) for n in levels]
    return Mixture(np.full(k, 1.0 / k), np.array(at), np.repeat(np.eye(d)[None], k, 0), cats, center, scale)


def blocks(m: Mixture, x: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
    """Rows with the same numbers missing: (rows, responsibilities [rows, k], terms [rows, t], log-likelihood, o, u, w, b, extra).

    Terms are 1, the known numbers and their products, so log-densities of all components are one product of matrices, and so are
    the sums that EM needs. o and u are the known and missing places; a missing number is z[o] w + b by component, with
    covariance extra. c: -1 is missing.
    """
    z = (x - m.center) / m.scale
    seen = np.isfinite(z)
    logs = [np.log(t) for t in m.cats]
    code = seen @ (1 << np.arange(x.shape[1]))
    for p in np.unique(code):
        rows = np.flatnonzero(code == p)
        o, u = np.flatnonzero(seen[rows[0]]), np.flatnonzero(~seen[rows[0]])
        d = len(o)
        i, j = np.triu_indices(d)
        zo = z[rows][:, o]
        terms = np.concatenate([np.ones((len(rows), 1)), zo, zo[:, i] * zo[:, j]], 1)
        mean = m.mean[:, o]
        inv = np.linalg.inv(m.cov[:, o[:, None], o]) if d else np.empty((len(m.weight), 0, 0))
        lin = np.einsum("kij,kj->ki", inv, mean)
        const = np.log(m.weight) - 0.5 * (mean * lin).sum(1) - 0.5 * d * np.log(2 * np.pi)
        if d:
            const = const + 0.5 * np.linalg.slogdet(inv)[1]
        logp = terms @ np.concatenate([const[:, None], lin, -inv[:, i, j] * np.where(i == j, 0.5, 1.0)], 1).T
        for q, theta in enumerate(logs):
            known = np.flatnonzero(c[rows, q] >= 0)
            logp[known] += theta[:, c[rows[known], q]].T
        top = logp.max(1, keepdims=True)
        r = np.exp(logp - top)
        total = r.sum(1, keepdims=True)
        cross = m.cov[:, o[:, None], u]
        w = inv @ cross
        b = m.mean[:, u] - np.einsum("ko,kou->ku", mean, w)
        extra = m.cov[:, u[:, None], u] - cross.transpose(0, 2, 1) @ w
        yield rows, r / total, terms, float((top + np.log(total)).sum()), o, u, w, b, extra


def statistics(m: Mixture, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    k, d = m.mean.shape
    ll, s0, s1, s2 = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    tables = [np.zeros_like(t) for t in m.cats]
    for rows, r, terms, more, o, u, w, b, extra in blocks(m, x, c):
        ll += more
        t = r.T @ terms
        n, t1, t2 = t[:, 0], t[:, 1 : 1 + len(o)], np.zeros((k, len(o), len(o)))
        i, j = np.triu_indices(len(o))
        t2[:, i, j] = t2[:, j, i] = t[:, 1 + len(o) :]
        t1u = np.einsum("ko,kou->ku", t1, w)
        ou = t2 @ w + t1[:, :, None] * b[:, None, :]
        s0 += n
        s1[:, o] += t1
        s1[:, u] += t1u + n[:, None] * b
        s2[:, o[:, None], o] += t2
        s2[:, o[:, None], u] += ou
        s2[:, u[:, None], o] += ou.transpose(0, 2, 1)
        s2[:, u[:, None], u] += w.transpose(0, 2, 1) @ ou + b[:, :, None] * (t1u + n[:, None] * b)[:, None, :] + n[:, None, None] * extra
        for q, table in enumerate(tables):
            known = np.flatnonzero(c[rows, q] >= 0)
            table += r[known].T @ np.eye(table.shape[1])[c[rows[known], q]]
    return np.concatenate([np.array([ll]), s0, s1.ravel(), s2.ravel(), *[t.ravel() for t in tables]])


def maximise(m: Mixture, s: np.ndarray, ridge: float = 1e-2) -> Mixture:
    k, d = m.mean.shape
    at = 1
    s0 = s[at : at + k] + 1e-6
    s1 = s[at + k : at + k + k * d].reshape(k, d)
    at += k + k * d
    s2 = s[at : at + k * d * d].reshape(k, d, d)
    at += k * d * d
    mean = s1 / s0[:, None]
    # one pseudo-row of unit variance keeps a starved component proper
    cov = (s2 - s0[:, None, None] * np.einsum("ki,kj->kij", mean, mean) + np.eye(d)) / (s0 + 1)[:, None, None] + ridge * np.eye(d)
    cats = []
    for theta in m.cats:
        t = s[at : at + theta.size].reshape(theta.shape) + 0.1
        at += theta.size
        cats.append(t / t.sum(1, keepdims=True))
    return Mixture(s0 / s0.sum(), mean, cov, cats, m.center, m.scale)


def _arrays(pdf: pd.DataFrame, numbers: list[str], cats: list[str]):
    return pdf[numbers].to_numpy("float64", na_value=np.nan), pdf[cats].fillna(-1).to_numpy("int64")


def fit(df: DataFrame, numbers: list[str], cats: list[str], levels: list[int], k: int = COMPONENTS, iterations: int = ITERATIONS, tol: float = 1e-4) -> Mixture:
    """EM over all rows of df: double columns ``numbers`` and int columns ``cats`` (0..levels-1); null is missing."""
    row = df.agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(numbers)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(numbers)]).first()
    center = np.array([row[f"a{i}"] or 0.0 for i in range(len(numbers))])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(len(numbers))])
    first = df.select(*numbers).orderBy(F.xxhash64(*numbers)).limit(INIT_ROWS).toPandas()
    m = start(first.to_numpy("float64", na_value=np.nan), levels, k, center, scale)
    last = -np.inf
    for _ in range(iterations):

        def run(batches: Iterator[pd.DataFrame], m=m) -> Iterator[pd.DataFrame]:
            total = statistics(m, np.empty((0, len(numbers))), np.empty((0, len(cats)), "int64"))
            for pdf in batches:
                total = total + statistics(m, *_arrays(pdf, numbers, cats))
            yield pd.DataFrame({"pos": np.arange(len(total)), "v": total})

        rows = df.select(*numbers, *cats).mapInPandas(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
        s = np.zeros(len(rows))
        for r in rows:
            s[r["pos"]] = r["v"]
        if not len(s):
            return m
        m = maximise(m, s)
        if abs(s[0] - last) < tol * abs(s[0]):
            break
        last = s[0]
    return m


def conditional(df: DataFrame, m: Mixture, numbers: list[str], cats: list[str]) -> DataFrame:
    """Adds x_<number> (conditional expectation where missing) and x_<cat> (mode where missing) to each row."""
    add = ", ".join([f"x_{c} double" for c in numbers] + [f"x_{c} int" for c in cats])
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, c = _arrays(pdf, numbers, cats)
            r, est = np.empty((len(x), len(m.weight))), np.empty_like(x)
            for rows, part, terms, _, o, u, w, b, _ in blocks(m, x, c):
                r[rows] = part
                zo = terms[:, 1 : 1 + len(o)]
                est[np.ix_(rows, u)] = np.einsum("nk,no,kou->nu", part, zo, w, optimize=True) + part @ b
            est = est * m.scale + m.center
            for i, name in enumerate(numbers):
                pdf[f"x_{name}"] = np.where(np.isfinite(x[:, i]), x[:, i], est[:, i])
            for q, name in enumerate(cats):
                pdf[f"x_{name}"] = np.where(c[:, q] >= 0, c[:, q], (r @ m.cats[q]).argmax(1)).astype("int32")
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + add
    return df.mapInPandas(run, schema).select(*names, *[f"x_{c}" for c in [*numbers, *cats]])


KINDS = ["OK", "PARTIAL", "MISSING", "EMPTY", "LOAD_ERROR"]


def status_kind(c: Column) -> Column:
    """Usable status as its place in KINDS, whatever its case and blanks; null otherwise."""
    s = F.upper(F.trim(F.regexp_replace(c, "\\s+", " ")))
    return (
        F.when(s == "OK", 0).when(s.rlike("^PARTIAL ?\\(.*\\)$"), 1).when(s.rlike("^MISSING_."), 2).when(s.rlike("^EMPTY_."), 3).when(s.rlike("^LOAD_ERROR"), 4)
    )


def usable(df: DataFrame) -> DataFrame:
    """u_modularity, u_n_communities, u_status: the usable value or null."""
    m, n = F.col("modularity"), F.col("n_communities")
    return df.withColumns({
        "u_modularity": F.when(~F.isnan(m) & m.between(-0.5, 1.0), m),
        "u_n_communities": F.when(n.between(1, 12), n.cast("int")),
        "u_status": status_kind(F.col("status")).cast("int"),
    })


def _good(c: str, low: float, high: float) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (x > low) & (x <= high), x)


NUMBERS = ["u_modularity", "g_modularity", "g_communities", "f_nodes", "f_entropy", "f_largest", "f_degree"]
CATS = ["c_communities", "u_status", "g_mode"]
LEVELS = [12, 5, 12]


def features(df: DataFrame) -> DataFrame:
    """Model input of the computed rows (n_nodes given). What the other rows of the same sequence and
    variant hold enters without the row itself: means of modularity and n_communities, and their mode."""
    rows = usable(df.filter("n_nodes IS NOT NULL"))
    key = F.concat_ws("|", F.lower(F.trim(F.coalesce("sequence", "dps_dir"))), "variant")
    rows = rows.select("feature_id", key.alias("grp"), "modularity", "n_communities", "status", "u_modularity", "u_n_communities", "u_status",
        F.ln(_good("n_nodes", 0, 1e12)).alias("f_nodes"), _good("community_size_entropy", -1e-9, 20).alias("f_entropy"), _good("largest_community_frac", 0, 1).alias("f_largest"), F.ln(_good("degree_mean", 0, 1e9)).alias("f_degree"))
    sums = rows.groupBy("grp").agg(F.sum("u_modularity").alias("sm"), F.count("u_modularity").alias("nm"), F.sum("u_n_communities").alias("sc"), F.count("u_n_communities").alias("nc"))
    votes = rows.filter("u_n_communities IS NOT NULL").groupBy("grp", "u_n_communities").agg(F.count("*").alias("v"))
    w = Window.partitionBy("grp").orderBy(F.desc("v"), "u_n_communities")
    votes = votes.withColumn("r", F.row_number().over(w)).groupBy("grp").agg(
        *[F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{c[0]}{i}") for i in (1, 2) for c in ("u_n_communities", "v")]
    )  # at most 12 rows of a group
    j = rows.join(sums, "grp", "left").join(votes, "grp", "left")
    own_m, own_c = F.coalesce("u_modularity", F.lit(0.0)), F.coalesce("u_n_communities", F.lit(0))
    nm = F.col("nm") - F.col("u_modularity").isNotNull().cast("int")
    nc = F.col("nc") - F.col("u_n_communities").isNotNull().cast("int")
    second = (F.col("u_n_communities") == F.col("u1")) & (F.col("v1") - 1 < F.coalesce("v2", F.lit(0)))
    alone = (F.col("u_n_communities") == F.col("u1")) & (F.col("v1") == 1) & F.col("u2").isNull()
    return j.select(
        "feature_id", "modularity", "n_communities", "status", "u_modularity", "u_n_communities", "u_status", "f_nodes", "f_entropy", "f_largest", "f_degree",
        F.when(nm > 0, (F.col("sm") - own_m) / nm).alias("g_modularity"),
        F.when(nc > 0, (F.col("sc") - own_c) / nc).cast("double").alias("g_communities"),
        (F.col("u_n_communities") - 1).alias("c_communities"),
        F.when(~F.coalesce(alone, F.lit(False)), F.when(second, F.col("u2")).otherwise(F.col("u1")) - 1).cast("int").alias("g_mode"),
    )


def fill_features(scratch: Scratch, df: DataFrame, k: int = COMPONENTS, iterations: int = ITERATIONS) -> DataFrame:
    """Computed rows with modularity, n_communities and status filled, each with <field>_filled (boolean).

    A usable value is kept as written. Fills: modularity the conditional expectation, cut to
    [-0.5, 1]; n_communities the mode from 1 to 12; status the kind (OK, PARTIAL, ...). Rows whose
    n_nodes is null were never computed and do not come out. An empty table gives no rows; rows without
    sequence, variant or any other feature are filled from the whole table's mixture.
    """
    rows = scratch.put(features(df), "features")
    m = fit(rows, NUMBERS, CATS, LEVELS, k, iterations)
    out = conditional(rows.select("feature_id", "modularity", "n_communities", "status", *NUMBERS, *CATS), m, NUMBERS, CATS)
    names = F.array(*[F.lit(x) for x in KINDS])
    return out.select(
        "feature_id",
        F.greatest(F.lit(-0.5), F.least(F.lit(1.0), F.col("x_u_modularity"))).alias("modularity"),
        F.col("u_modularity").isNull().alias("modularity_filled"),
        (F.col("x_c_communities") + 1).alias("n_communities"),
        F.col("c_communities").isNull().alias("n_communities_filled"),
        F.when(F.col("u_status").isNotNull(), F.col("status")).otherwise(F.get(names, F.col("x_u_status"))).alias("status"),
        F.col("u_status").isNull().alias("status_filled"),
    )


def fills(filled: DataFrame) -> DataFrame:
    """One row per filled cell: feature_id, field, value."""
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_filled").alias("marked"))
    return filled.select("feature_id", F.inline(F.array(cell("modularity"), cell("n_communities"), cell("status")))).filter("marked").select("feature_id", "field", "value")
