"""Feature groups, derived models, set kinetics and statistics on small cases, against numpy and brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_networks import dense, frames, random_network

from ctmcflow.operators import community, ctmc, features, reduce, stats
from ctmcflow.session import Scratch
from ctmcflow.sources import models
from ctmcflow.streaming import chain

N = 30


@pytest.fixture(scope="module")
def net(spark):
    minima, ts = frames(spark, {"x_19sb": random_network(N, 21), "lost": random_network(6, 3)})
    rates = ctmc.tst_rates(ts, minima).cache()
    k = dense(rates, "x_19sb", N)
    ab = spark.createDataFrame([("x_19sb", i, s) for s, ids in (("A", (0, 3, 7)), ("B", (11, 12))) for i in ids] + [("lost", 0, "A")], "network_id string, min_id long, side string")
    return minima, ts, rates, k, ab


def lengths(w):
    """All shortest lengths of a matrix of edge lengths, inf where there is no edge."""
    d = w.copy()
    np.fill_diagonal(d, 0)
    for m in range(len(d)):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1])
    return d


def test_feature_row(spark, net):
    minima, ts, rates, k, ab = net
    s = Scratch(spark, "f")
    pi = ctmc.equilibrium(minima)
    nodes = minima.select("network_id", F.col("min_id").alias("node"))
    moments = reduce.jump_moments(ctmc.branching(rates).select("network_id", "src", "dst", "b"), ctmc.waiting_times(rates).select("network_id", "node", "tau"))
    pairs = ctmc.pair_barriers(ctmc.edge_barriers(ts, minima))
    m = features.Model(s, nodes, rates, ctmc.branching(rates).select("network_id", "src", "dst", "b"), pi, ab, s.put(moments, "m"), pairs)
    rows = {r["network_id"]: r for r in features.feature_row(m, ("sequence", "distance", "centrality", "path")).collect()}
    r = rows["x_19sb"]
    A, B = [0, 3, 7], [11, 12]
    with np.errstate(divide="ignore"):
        rate = -np.log(k)
        branch = -np.log(k / k.sum(1, keepdims=True))
    rate -= min(0, rate[np.isfinite(rate)].min())
    for name, w in (("branch", branch), ("rate", rate)):
        d = lengths(w)
        assert r[f"{name}_dist_ab_min"] == pytest.approx(d[np.ix_(A, B)].min()) and r[f"{name}_dist_ab_mean"] == pytest.approx(d[np.ix_(A, B)].mean())
        assert r[f"{name}_dist_ba_min"] == pytest.approx(d[np.ix_(B, A)].min()) and r[f"{name}_dist_ba_mean"] == pytest.approx(d[np.ix_(B, A)].mean())
        assert r[f"{name}_dist_asymmetry"] == pytest.approx(abs(d[np.ix_(A, B)].min() - d[np.ix_(B, A)].min()))
    bar = np.full((N, N), np.inf)
    for p in pairs.filter("network_id = 'x_19sb'").collect():
        bar[p["u"], p["v"]] = bar[p["v"], p["u"]] = p["barrier"]
    assert r["barrier_dist_ab_min"] == pytest.approx(lengths(bar)[np.ix_(A, B)].min()) and r["barrier_dist_ab_mean"] == pytest.approx(lengths(bar)[np.ix_(A, B)].mean())
    hops = lengths(np.where((k + k.T) > 0, 1.0, np.inf))
    least = hops[np.ix_(A, B)].min()
    assert r["shortest_path_hops_ab"] == least and r["n_short_pairs_ab"] == (hops[np.ix_(A, B)] <= 2 * least).sum() and r["path_redundancy"] == pytest.approx(r["n_short_pairs_ab"] / 6)
    assert r["rate_shortest_path_ab"] == pytest.approx(lengths(rate)[0, 11])
    vec = np.abs(np.linalg.eigh(((k + k.T) > 0).astype(float))[1][:, -1])
    vec /= vec.sum()
    assert r["eigvec_centrality_a"] == pytest.approx(vec[A].sum(), abs=1e-6)
    assert r["closeness_centrality_b"] == pytest.approx(sum((N - 1) / hops[i].sum() for i in B))
    p = {x["node"]: x["pi"] for x in pi.filter("network_id = 'x_19sb'").collect()}
    assert r["pi_a"] == pytest.approx(sum(p[i] for i in A)) and r["pi_ratio_ab"] == pytest.approx(sum(p[i] for i in A) / sum(p[i] for i in B))
    assert r["status"] == "OK" and r["length"] == 1 and rows["lost"]["status"] == "EMPTY_AB" and rows["lost"]["branch_dist_ab_min"] is None
    empty = features.Model(s, nodes.limit(0), rates.limit(0), m.branches.limit(0), pi.limit(0), ab.limit(0), m.moments.limit(0), pairs.limit(0))
    assert features.feature_row(empty, ("sequence", "distance", "path")).count() == 0


def test_reduced_models_and_set_rates(spark, net):
    minima, _, rates, k, ab = net
    one = lambda df: df.filter("network_id = 'x_19sb'")
    s = Scratch(spark, "r")
    w = one(ctmc.waiting_times(rates)).select("network_id", "node", "tau")
    micro = s.put(reduce.jump_moments(one(ctmc.branching(rates)).select("network_id", "src", "dst", "b"), w), "micro")
    pi = one(ctmc.equilibrium(minima))
    keep = spark.createDataFrame([("x_19sb", i) for i in range(0, N, 3)], "network_id string, node long")
    e = s.put(reduce.transform(s, micro, keep), "reduced")
    got = {r["node"]: r["pi_eff"] for r in reduce.stationary(e, pi, w).collect()}
    at = {n: i for i, n in enumerate(sorted(got))}
    q = np.zeros((len(at), len(at)))
    for r in reduce.reduced_generator(e).collect():
        q[at[r["src"]], at[r["dst"]]] = r["q"]
    value, vector = np.linalg.eig(q.T)
    v = np.real(vector[:, np.argmin(np.abs(value))])
    assert np.allclose(v / v.sum(), [got[n] for n in at], rtol=1e-9)
    p = np.array([r["pi"] for r in pi.orderBy("node").collect()])
    tau = 1 / k.sum(1)
    b = k * tau[:, None]
    r = next(r for r in reduce.set_kinetics(s, micro, pi, ab).collect() if r["network_id"] == "x_19sb")
    for way, S, T in (("ab", [0, 3, 7], [11, 12]), ("ba", [11, 12], [0, 3, 7])):
        free = [i for i in range(N) if i not in T]
        m = np.zeros(N)
        m[free] = np.linalg.solve(np.eye(len(free)) - b[np.ix_(free, free)], tau[free])
        inner = [i for i in range(N) if i not in S + T]
        c = np.zeros(N)
        c[T] = 1
        c[inner] = np.linalg.solve(np.eye(len(inner)) - b[np.ix_(inner, inner)], b[np.ix_(inner, T)].sum(1))
        away = np.zeros(N)  # time outside both sets after leaving
        away[inner] = np.linalg.solve(np.eye(len(inner)) - b[np.ix_(inner, inner)], tau[inner])
        share = p[S] / p[S].sum()
        assert r[f"mfpt_{way}"] == pytest.approx(share @ m[S]) and r[f"k_f_{way}"] == pytest.approx(share @ (1 / m[S])) and r[f"k_star_{way}"] == pytest.approx(1 / (share @ m[S]))
        assert r[f"k_ss_{way}"] == pytest.approx(share @ ((b @ c)[S] / tau[S])) and r[f"k_nss_{way}"] == pytest.approx(share @ ((b @ c)[S] / (tau + b @ away)[S]))
    lost = next(x for x in reduce.set_kinetics(s, micro, pi, ab).collect() if x["network_id"] == "lost")
    assert lost["n_b"] == 0 and lost["mfpt_ab"] is None


def test_spectral_communities():
    rng = np.random.default_rng(4)
    n, group = 90, np.arange(90) // 30
    w = np.where(group[:, None] == group, rng.uniform(0.5, 1, (n, n)), 0.01)
    np.fill_diagonal(w, 0)
    s, d = np.nonzero(w)
    for dense_limit in (200, 10):  # as a matrix, and by its edges only
        lab = community.spectral_labels(n, s, d, w[s, d], 10, dense_limit)
        assert len({(a, b) for a, b in zip(lab, group)}) == 3 == len(set(lab))
    assert community.spectral_labels(2, np.array([0, 1]), np.array([1, 0]), np.ones(2), 10, 200).tolist() == [0, 0]


def test_weighted_modularity(spark, net):
    _, _, rates, k, _ = net
    lab = np.arange(N) % 3
    labels = spark.createDataFrame([("x_19sb", i, int(c)) for i, c in enumerate(lab)], "network_id string, node long, comp long")
    w = (k + k.T) / 2
    m = w.sum() / 2
    want = sum(w[np.ix_(lab == c, lab == c)].sum() / 2 / m - (w[lab == c].sum() / (2 * m)) ** 2 for c in range(3))
    assert community.weighted_modularity(rates.filter("network_id = 'x_19sb'"), labels).first()["modularity"] == pytest.approx(want)


def test_quantiles_and_places(spark):
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][i % 3], float(v) if i % 11 else None, i) for i, v in enumerate(rng.integers(0, 40, 400))] + [("c", float("nan"), 900), ("hot", 1.0, 901)] + [("hot", 1.0, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {r["g"]: [r["n"], r["q0"], r["q1"], r["q2"]] for r in stats.quantiles(df, "v", [0.0, 0.37, 0.9], ["g"]).collect()}
    want = {}
    for g in ("a", "b", None, "hot"):
        x = [v for h, v, _ in rows if h == g and v is not None and v == v]
        want[g] = [len(x), *np.quantile(x, [0.0, 0.37, 0.9])]
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    assert stats.quantiles(df, "v", [0.5]).first()["q0"] == pytest.approx(np.median([v for _, v, _ in rows if v is not None and v == v]))
    assert stats.quantiles(df.limit(0), "v", [0.5]).count() == 0
    p = {r["n"]: r["place"] for r in stats.places(df.withColumnRenamed("n", "id").withColumn("g", F.coalesce("g", F.lit("?"))).select("g", F.col("id").alias("k")), "k", ["g"]).select(F.col("k").alias("n"), "place").collect()}
    assert all(p[n] == sum(m < n for h, _, m in rows if (h or "?") == (g or "?")) for g, _, n in rows)


def test_exact_p_values(spark):
    rnd = random.Random(2)
    for n1, n2 in ((3, 4), (5, 5), (2, 6)):
        x = [rnd.random() for _ in range(n1 + n2)]
        u = sum(a > b for a in x[:n1] for b in x[n1:])
        all_u = [sum(x[i] > x[j] for i in c for j in range(n1 + n2) if j not in c) for c in combinations(range(n1 + n2), n1)]
        far = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v >= far for v in all_u) / len(all_u))
        assert stats._exact_u(pd.Series([n1]), pd.Series([n2]), pd.Series([u]))[0] == pytest.approx(want)
    p = stats._student(pd.Series([2.228138852, 0.0, 12.7062047, 1.0, np.nan]), pd.Series([10.0, 5.0, 1.0, 1e4, 3.0]))
    assert p[:4].tolist() == pytest.approx([0.05, 1.0, 0.05, math.erfc(1 / math.sqrt(2))], abs=1e-4) and p.isna()[4]
    assert stats.mann_whitney(spark.createDataFrame([], "g string, v double"), "v", "g").count() == 0


def test_leave_one_out_of_penalised_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [0.7, 0.0] + rng.normal(size=40) * 0.3
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, y double")
    r = {m["model"]: m for m in stats.loo_penalised(df, ["a", "b"], "y", {"lasso": (0.1, 1.0), "none": (0.0, 1.0)}).collect()}
    X = np.c_[np.ones(40), x]
    for name, alpha in (("lasso", 0.1), ("none", 0.0)):
        e = []
        for i in range(40):
            k = np.arange(40) != i
            e.append(y[i] - X[i] @ stats.descend(X[k].T @ X[k], X[k].T @ y[k], 39, alpha, 1.0))
        assert r[name]["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(e)))) and r[name]["n"] == 40
    ols = stats.loo(df, ["a", "b"], "y").agg(*stats.metrics("y", "loo")).first()
    assert r["none"]["r2"] == pytest.approx(ols["r2"], abs=1e-8)
    assert [s[1] for s in stats.forward_selection(df, ["a", "b"], "y")][0] == "a"


def test_steps_across_hours(spark):
    rnd = random.Random(6)
    base = pd.Timestamp("2024-01-01")
    rows = [(i, base + pd.Timedelta(minutes=rnd.choice([0, 1, 59, 60, 61, 240, 241, 900])), rnd.randint(0, 3), rnd.choice("xyz")) for i in range(120)]
    df = spark.createDataFrame([(i, t.to_pydatetime(), u, k) for i, t, u, k in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    want = []
    for u in range(4):
        mine = sorted((t, i, k) for i, t, v, k in rows if v == u)
        want += [(u, a[2], b[2], int((b[0] - a[0]).total_seconds() * 1e6)) for a, b in zip(mine, mine[1:])]
    assert sorted(tuple(r) for r in chain.event_steps(df).collect()) == sorted(want)


def test_model_without_rates_is_an_error(spark, tmp_path):
    spark.createDataFrame([("x", 0, 1.0)], "network_id string, node long, tau double").write.parquet(f"file://{tmp_path}/m/tau")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, f"file://{tmp_path}/m")
    made = []
    for _ in range(2):
        assert models.cached(spark, f"file://{tmp_path}/c", {"a": 1}, 1, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
