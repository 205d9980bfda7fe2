"""CTMC, graph and graph-transformation operators on small chains, against numpy and by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctmcflow.functions import sequence as seq
from ctmcflow.operators import ctmc, graph, reduce, stats
from ctmcflow.session import Scratch
from ctmcflow.sources import sinks, text
from ctmcflow.streaming import chain


def random_network(n, seed, extra=1.5):
    rng = np.random.default_rng(seed)
    e = rng.uniform(0, 4, n)
    p = rng.uniform(0, 1, n)
    edges = {(i, int(rng.integers(0, i))) for i in range(1, n)} | {tuple(sorted(rng.choice(n, 2, replace=False))[::-1]) for _ in range(int(extra * n))}
    ts = [(int(a), int(b), max(e[a], e[b]) + rng.uniform(0.2, 2)) for a, b in edges]
    return e, p, ts


def frames(spark, nets):
    m, t = [], []
    for name, (e, p, ts) in nets.items():
        m += [(name, i, float(e[i]), float(p[i])) for i in range(len(e))]
        t += [(name, k, a, b, float(v), 0.1) for k, (a, b, v) in enumerate(ts)]
    return spark.createDataFrame(m, "network_id string, min_id long, energy double, log_prod double"), spark.createDataFrame(t, "network_id string, ts_order long, f long, i long, e_ts double, s_ts double")


def dense(rates, name, n):
    k = np.zeros((n, n))
    for r in rates.filter(F.col("network_id") == name).collect():
        k[r["src"], r["dst"]] = r["k"]
    return k


def passage(k, a, b):
    """Mean and variance of the time from a to b by linear solves."""
    tau = 1 / k.sum(1)
    p = k * tau[:, None]
    free = [i for i in range(len(k)) if i != b]
    A = np.eye(len(free)) - p[np.ix_(free, free)]
    m = np.linalg.solve(A, tau[free])
    m2 = np.linalg.solve(A, 2 * tau[free] ** 2 + 2 * tau[free] * (p[np.ix_(free, free)] @ m))
    i = free.index(a)
    return m[i], m2[i] - m[i] ** 2


@pytest.fixture(scope="module")
def model(spark):
    nets = {"x": random_network(40, 1), "y": random_network(25, 2), "two": (np.array([0.0, 1.0]), np.zeros(2), [(1, 0, 2.0)])}
    minima, ts = frames(spark, nets)
    rates = ctmc.tst_rates(ts, minima).cache()
    return nets, minima, ts, rates


def test_rates_are_reversible(spark, model):
    _, minima, _, rates = model
    pi = ctmc.equilibrium(minima)
    assert all(r["worst"] < 1e-12 for r in ctmc.detailed_balance(rates, pi).collect())
    q = ctmc.generator(rates)
    assert all(r["qpi_rel"] < 1e-14 for r in ctmc.stationarity(q, pi).collect())
    assert all(r["max_abs_colsum"] < 1e-10 and r["diag_pos_count"] == 0 and r["off_neg_count"] == 0 for r in ctmc.generator_sanity(q).collect())
    assert all(abs(r["s"] - 1) < 1e-12 for r in ctmc.branching(rates).groupBy("network_id", "src").agg(F.sum("b").alias("s")).collect())


@pytest.mark.parametrize("limit", [8, 300])
def test_transformation_preserves_passage_times(spark, model, limit):
    """limit 8 goes through distributed rounds, 300 through the dense finish."""
    nets, minima, _, rates = model
    s = Scratch(spark, "gt")
    ab = ctmc.part_ab(minima)
    micro = reduce.jump_moments(ctmc.branching(rates).select("network_id", "src", "dst", "b"), ctmc.waiting_times(rates))
    keep = minima.filter("min_id % 4 = 0").select("network_id", F.col("min_id").alias("node")).union(ab.select("network_id", "min_id"))
    e = s.put(reduce.transform(s, micro, keep, dense=limit), "reduced")
    sums = e.groupBy("network_id", "src").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-10 for r in sums)
    got = {r["network_id"]: r for r in reduce.passage(s, e, ab).collect()}
    sides = {(r["network_id"], r["side"]): r["min_id"] for r in ab.collect()}
    for name, (en, _, _) in nets.items():
        k = dense(rates, name, len(en))
        a, b = sides[name, "A"], sides[name, "B"]
        for x, y, c in ((a, b, "ab"), (b, a, "ba")):
            m, v = passage(k, x, y)
            assert got[name][f"mfpt_{c}"] == pytest.approx(m, rel=1e-9) and got[name][f"var_{c}"] == pytest.approx(v, rel=1e-8)


def test_committor_and_spectrum(spark, model):
    nets, minima, _, rates = model
    s = Scratch(spark, "cs")
    ab = ctmc.part_ab(minima)
    micro = reduce.jump_moments(ctmc.branching(rates).select("network_id", "src", "dst", "b"), ctmc.waiting_times(rates))
    q = {(r["network_id"], r["node"]): r for r in reduce.committor_mfpt(micro, ab).collect()}
    sides = {(r["network_id"], r["side"]): r["min_id"] for r in ab.collect()}
    for name, (en, _, _) in nets.items():
        k = dense(rates, name, len(en))
        assert q[name, sides[name, "B"]]["committor"] == 1 and q[name, sides[name, "A"]]["committor"] == 0
        assert q[name, sides[name, "A"]]["mfpt_to_b"] == pytest.approx(passage(k, sides[name, "A"], sides[name, "B"])[0], rel=1e-9)
        assert all(0 <= q[name, i]["committor"] <= 1 for i in range(len(en)))
    modes = {(r["network_id"], r["mode"]): r["lambda"] for r in reduce.spectrum(micro, ab).collect()}
    k = dense(rates, "x", 40)
    ev = np.sort(np.linalg.eigvals(k - np.diag(k.sum(1))).real)[::-1]
    assert modes["x", 1] == pytest.approx(ev[1], rel=1e-6)
    t = dense(rates, "two", 2)
    assert modes["two", 1] == pytest.approx(-(t[0, 1] + t[1, 0]))
    f = {r["network_id"]: r for r in reduce.spectral_features(reduce.spectrum(micro, ab, 10), micro).collect()}
    ten = -ev[1:11]
    share = ten / ten.sum()
    assert f["x"]["gap_ratio"] == pytest.approx(ten[0] / ten[1], rel=1e-6) and f["x"]["gap"] == f["x"]["fiedler"]
    assert f["x"]["entropy"] == pytest.approx(-(share * np.log(share)).sum(), rel=1e-6)
    mean_degree = (k > 0).sum() / len(k)
    assert f["x"]["ramanujan_score"] == pytest.approx(ten[0] / (2 * np.sqrt(max(2, mean_degree) - 1)), rel=1e-6)
    assert f["two"]["gap_ratio"] is None and f["two"]["effective_dimension"] == pytest.approx(1)


def test_components_shapes(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 5)], "network_id string, node long")
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(39)] + [("a", 50, 51), ("a", 51, 50), ("a", 52, 52)], "network_id string, src long, dst long")
    got = {(r["network_id"], r["node"]): r["comp"] for r in graph.components(Scratch(spark, "c"), nodes, edges).collect()}
    assert all(got["a", i] == 0 for i in range(40)) and got["a", 51] == 50 and got["a", 52] == 52 and got["b", 5] == 5
    assert graph.components(Scratch(spark, "c"), nodes.limit(0), edges.limit(0)).count() == 0


def test_known_graphs(spark):
    k4 = [("k4", i, j) for i in range(4) for j in range(i)]
    tri = [("t", 0, 1), ("t", 1, 2), ("t", 0, 2), ("t", 3, 4), ("t", 4, 5), ("t", 3, 5)]
    edges = spark.createDataFrame(k4 + tri, "network_id string, src long, dst long")
    nodes = spark.createDataFrame([("k4", i) for i in range(4)] + [("t", i) for i in range(6)], "network_id string, node long")
    c = {(r["network_id"], r["node"]): r for r in graph.triangles(nodes, edges).collect()}
    assert all(c["k4", i]["triangles"] == 3 and c["k4", i]["clustering"] == 1 for i in range(4)) and c["t", 0]["triangles"] == 1
    lab = graph.components(Scratch(spark, "m"), nodes, edges)
    m = {r["network_id"]: r for r in graph.modularity(edges, lab).collect()}
    assert m["t"]["modularity"] == pytest.approx(0.5) and m["k4"]["modularity"] == pytest.approx(0.0)
    r = graph.pagerank(Scratch(spark, "p"), nodes, edges.union(edges.select("network_id", "dst", "src")).withColumn("k", F.lit(1.0)))
    assert all(abs(x["s"] - 1) < 1e-12 for x in r.groupBy("network_id").agg(F.sum("r").alias("s")).collect())


def test_keep_rules_and_sweep(spark, model):
    _, minima, ts, rates = model
    b = ctmc.edge_barriers(ts, minima)
    kept = graph.basin_keep_set(Scratch(spark, "k"), minima, b, ctmc.part_ab(minima), [0.0, 0.5, 1.0, 4.0]).groupBy("network_id", "cut").count().collect()
    by = {(r["network_id"], r["cut"]): r["count"] for r in kept}
    assert all(by[n, 0.0] >= by[n, 0.5] >= by[n, 1.0] >= by[n, 4.0] for n in ("x", "y"))
    w = ctmc.waiting_times(rates).select("network_id", "node", "tau")
    s = ctmc.equilibrium(minima).join(w, ["network_id", "node"]).withColumn("must", F.col("node") == 0)
    for style in ctmc.KEEP_STYLES:
        k = {r["network_id"]: r["n"] for r in ctmc.keep_states(s, style, 5.0, 10).filter("kept").groupBy("network_id").agg(F.count("*").alias("n")).collect()}
        assert k["x"] >= 10 and k["y"] >= 10 and k["two"] == 2


def test_sequence_functions(spark):
    rows = [("aaaaaa",), ("KkKkKk",), ("keggek",), ("",), ("xyz",), (None,)]
    df = spark.createDataFrame(rows, "s string").select("s", *[c.alias(k) for k, c in seq.composition(F.col("s")).items()], seq.sequence_class(F.col("s")).alias("cls"))
    r = {x["s"]: x for x in df.collect()}
    assert r["aaaaaa"]["hydropathy_mean"] == pytest.approx(1.8) and r["aaaaaa"]["cls"] == "hydrophobic"
    assert r["KkKkKk"]["net_charge"] == 6 and r["KkKkKk"]["cls"] == "charged" and r["keggek"]["net_charge"] == 0 and r["keggek"]["cls"] == "mixed"
    assert r[""]["frac_pos"] == 0 and r[None]["length"] == 0 and r["xyz"]["frac_aromatic"] == pytest.approx(1 / 3)


def test_leave_one_out_equals_refits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=30)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    for alpha in (0.0, 2.0):
        got = {r["id"]: r["loo"] for r in stats.loo(df, ["a", "b"], "y", alpha).collect()}
        X = np.c_[np.ones(30), x]
        for i in range(30):
            m = np.arange(30) != i
            beta = np.linalg.solve(X[m].T @ X[m] + alpha * np.diag([0, 1, 1]), X[m].T @ y[m])
            assert got[i] == pytest.approx(X[i] @ beta, rel=1e-8)
    s = Scratch(spark, "st")
    idx = s.put(stats.ranks(s, df, "y", "id"), "i")
    assert sorted(r["rn"] for r in idx.collect()) == list(range(1, 31))
    p = stats.permutation_test(idx, ["a", "b"], "y", 60)
    assert p["observed"] > 0.5 and p["p"] < 0.05
    one = stats.shuffled(idx, 30, 3, "a")
    assert all(sorted(v) == sorted(x[:, 0].tolist()) for v in ([r["s_a"] for r in one.filter(F.col("rep") == k).collect()] for k in range(3)))


def test_penalised_models(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - 0.7 * x[:, 1] + 1.5 + rng.normal(size=300)
    df = spark.createDataFrame([(f"k{i}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id string, a double, b double, c double, y double").cache()
    xs = ["a", "b", "c"]
    g, b, _, _, n = stats.gram(df, xs, "y")
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(df)
    X = np.c_[np.ones(300), x]
    for alpha, l1 in ((0.1, 1.0), (0.5, 0.5), (0.3, 0.0), (0.0, 1.0)):  # the conditions of a minimum
        w = stats.descend(g, b, n, alpha, l1)
        slope = X.T @ (X @ w - y) / n + np.r_[0, alpha * (1 - l1) * w[1:]]
        bound = np.r_[0, np.full(3, alpha * l1)]
        assert np.all(np.where(w != 0, np.abs(slope + bound * np.sign(w)), np.maximum(0, np.abs(slope) - bound)) < 1e-9)
    for alpha, l1 in ((0.1, 1.0), (0.0, 1.0)):  # the library scales the squared penalty by the target's deviation, so only these are the same model
        m = LinearRegression(labelCol="y", regParam=alpha, elasticNetParam=l1, standardization=False, tol=1e-12, maxIter=500).fit(v)
        assert stats.descend(g, b, n, alpha, l1) == pytest.approx([m.intercept, *m.coefficients], abs=1e-5)
    grid = [0.01, 0.1, 1.0]
    fold = {r["id"]: r["f"] for r in df.selectExpr("id", "pmod(xxhash64(id), 5) f").collect()}
    f = np.array([fold[f"k{i}"] for i in range(300)])

    def left(alpha, out, test):
        w = stats.descend(X[~out].T @ X[~out], X[~out].T @ y[~out], int((~out).sum()), alpha, 1.0)
        return ((y[test] - X[test] @ w) ** 2).sum()

    def pick(out):
        return min(grid, key=lambda a: (sum(left(a, out | (f == k), ~out & (f == k)) for k in range(5)), -a))

    want = sum(left(pick(f == k), f == k, f == k) for k in range(5))
    got = {r[0]: r for r in stats.penalised(df, xs, "y", "id", {"one": ([0.1], [1.0]), "cv": (grid, [1.0]), "none": ([100.0], [1.0])})}
    assert got["one"][4] == pytest.approx(np.sqrt(sum(left(0.1, f == k, f == k) for k in range(5)) / 300))
    assert got["cv"][3] == pytest.approx(1 - want / ((y - y.mean()) ** 2).sum())
    assert got["cv"][1] == pick(np.zeros(300, bool)) and got["none"][6] == 0
    assert stats.penalised(df.limit(0), xs, "y", "id", {"one": ([0.1], [1.0])})[0][3:6] == (None, None, 0)


def test_two_sided_p(spark):
    from math import erfc

    zs = [0.0, -0.5, 1.0, 1.96, -3.0, 8.0]
    got = [r["p"] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([erfc(abs(z) / 2**0.5) for z in zs], abs=2e-7)


def test_text_round_trip_and_discovery(spark, tmp_path):
    d = tmp_path / "abc_nocap" / "abc_19sb_nocap"
    d.mkdir(parents=True)
    (d / "min.data").write_text("# note\n  -1.5 2.0 1 0.1 0.2 0.3\n\nbad line\n 0.5 1.0 1 0.1 0.2 0.3\n")
    (d / "ts.data").write_text("1.0 0.5 1 1 2 0 0 0\nbroken\n2.0 0.5 1 2 1 0 0 0\n")
    (d / "min.A").write_text("2\n1\n2\n")
    m = text.scan_minima(spark, str(d / "min.data")).orderBy("min_id").collect()
    assert [(r["network_id"], r["min_id"], r["energy"]) for r in m] == [("abc_19sb", 1, -1.5), ("abc_19sb", 2, 0.5)]
    assert [(r["f"], r["i"]) for r in text.scan_ts(spark, str(d / "ts.data")).orderBy("ts_id").collect()] == [(1, 2), (2, 1)]
    assert sorted(r["min_id"] for r in text.scan_ids(spark, str(d / "min.A")).collect()) == [1, 2]
    assert [r["network_id"] for r in text.discover(spark, str(tmp_path)).collect()] == ["abc_19sb"]
    out = str(tmp_path / "sink")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    sinks.append_new(a, out, "k")
    sinks.append_new(a.union(spark.createDataFrame([(3, "z")], "k long, v string")), out, "k")
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert spark.range(1).select(sinks.cut_label(F.lit(1.5)).alias("l")).first()["l"] == "dE1p50"
    sinks.write_csv([a, a.withColumn("w", F.lit(1))], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i * 7 % 50, i % 5, "abc"[i * i % 3], 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df = df.withColumn("ts", F.timestamp_micros(F.col("s") * 1_000_000 + F.col("event_id"))).select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = chain.run_stream(spark, str(tmp_path / "in"), "*.parquet", str(tmp_path / "out"), str(tmp_path / "cp"))
    want = chain.event_steps(df)
    key = lambda d: sorted((r["user_id"], r["src"], r["dst"], r["dwell"]) for r in d.collect())
    assert key(got) == key(want)
