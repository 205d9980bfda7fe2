"""Queries on kinetic networks derived from parts sharing orders, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ctmcflow.operators import ctmc, graph, reduce, single, stats
from ctmcflow.operators.graph import NET
from ctmcflow.session import Scratch, kept

CUT = 3.0
CUTS = [1.0, 3.0, 9.0, 27.0]

# --- the relations in SQL -----------------------------------------------------------------------
CTE = {
    "minima": "SELECT p_brand AS network_id, p_partkey AS min_id, (p_retailprice - CAST(900 AS DOUBLE)) / CAST(10 AS DOUBLE) AS energy, p_size / CAST(50 AS DOUBLE) AS log_prod FROM part",
    "ts": """SELECT x.b AS network_id, x.o AS ts_order, x.k AS f, y.k AS i, GREATEST(mf.energy, mi.energy) + (1 + x.o % 7) / CAST(4 AS DOUBLE) AS e_ts, (x.o % 5) / CAST(50 AS DOUBLE) AS s_ts
FROM (SELECT DISTINCT l.l_orderkey AS o, l.l_partkey AS k, p.p_brand AS b FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) x
JOIN (SELECT DISTINCT l.l_orderkey AS o, l.l_partkey AS k, p.p_brand AS b FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) y ON x.o = y.o AND x.b = y.b AND x.k < y.k
JOIN minima mf ON mf.network_id = x.b AND mf.min_id = x.k JOIN minima mi ON mi.network_id = x.b AND mi.min_id = y.k""",
    "ab": "SELECT network_id, min_id, CASE WHEN rn = 1 THEN 'A' ELSE 'B' END AS side FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY energy, min_id) AS rn FROM minima m) WHERE rn <= 2",
    "barriers": "SELECT t.network_id, t.ts_order, t.f, t.i, mf.energy AS e_f, mi.energy AS e_i, t.e_ts, GREATEST(0.0, t.e_ts - LEAST(mf.energy, mi.energy)) AS barrier FROM ts t JOIN minima mf ON mf.network_id = t.network_id AND mf.min_id = t.f JOIN minima mi ON mi.network_id = t.network_id AND mi.min_id = t.i WHERE t.f <> t.i",
    "rates": """SELECT network_id, src, dst, SUM(k) AS k FROM (
SELECT t.network_id, t.f AS src, t.i AS dst, EXP(-(t.e_ts - m.energy) + m.log_prod - t.s_ts) AS k FROM ts t JOIN minima m ON m.network_id = t.network_id AND m.min_id = t.f
UNION ALL SELECT t.network_id, t.i, t.f, EXP(-(t.e_ts - m.energy) + m.log_prod - t.s_ts) FROM ts t JOIN minima m ON m.network_id = t.network_id AND m.min_id = t.i) GROUP BY 1, 2, 3""",
    "wait": "SELECT network_id, src AS node, SUM(k) AS escape, 1 / SUM(k) AS tau FROM rates GROUP BY 1, 2",
    "branch": "SELECT r.network_id, r.src, r.dst, r.k, r.k / w.escape AS b FROM rates r JOIN wait w ON w.network_id = r.network_id AND w.node = r.src",
    "pi": "SELECT network_id, min_id AS node, w / SUM(w) OVER (PARTITION BY network_id) AS pi FROM (SELECT network_id, min_id, EXP(x - MAX(x) OVER (PARTITION BY network_id)) AS w FROM (SELECT network_id, min_id, -energy - log_prod AS x FROM minima))",
    "q": "SELECT network_id, src, dst, k AS q FROM rates UNION ALL SELECT network_id, node, node, -escape FROM wait",
    "und": "SELECT DISTINCT network_id, src, dst FROM rates WHERE src <> dst",
    "nodes": "SELECT network_id, min_id AS node FROM minima",
    "deg": "SELECT n.network_id, n.node, COUNT(u.dst) AS deg FROM nodes n LEFT JOIN und u ON u.network_id = n.network_id AND u.src = n.node GROUP BY 1, 2",
    "reach": "SELECT network_id, node AS root, node FROM nodes UNION SELECT r.network_id, r.root, u.dst FROM reach r JOIN und u ON u.network_id = r.network_id AND u.src = r.node",
    "comp": "SELECT network_id, node, MIN(root) AS comp FROM reach GROUP BY 1, 2",
    "states": "SELECT p.network_id, p.node, p.pi, w.tau, p.node IN (SELECT min_id FROM ab WHERE ab.network_id = p.network_id) AS must, -LN(GREATEST(p.pi, 1e-300)) AS fe FROM pi p JOIN wait w ON w.network_id = p.network_id AND w.node = p.node",
    "cuts": "SELECT network_id, quantile_cont(fe, 0.05) AS fe_cut, quantile_cont(tau, 0.95) AS tau_cut FROM states WHERE NOT must GROUP BY 1",
}
ORDER = list(CTE)
NEEDS = {"minima": [], "ts": ["minima"], "ab": ["minima"], "barriers": ["ts"], "rates": ["ts"], "wait": ["rates"], "branch": ["wait"], "pi": ["minima"], "q": ["wait"], "und": ["rates"], "nodes": ["minima"], "deg": ["und", "nodes"], "reach": ["und", "nodes"], "comp": ["reach"], "states": ["pi", "wait", "ab"], "cuts": ["states"]}


def with_(*names: str, more: str = "") -> str:
    need: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += NEEDS[n]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n == 'reach' else 'MATERIALIZED '}({CTE[n]})" for n in ORDER if n in need) + (",\n" + more if more else "") + "\n"


# --- the relations in Spark ---------------------------------------------------------------------
class Ktn:
    """The relations of one scale. Each is derived and written once in a session, by the first query that needs it."""

    def __init__(self, spark: SparkSession, sf: str, label: str):
        self.scratch = Scratch(spark, label)
        self._kept = kept(spark, sf, ["part", "lineitem"], "ktn")
        self._from = (spark, sf)

    def keep(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = self._kept["scratch"].put(make(), name)
        return self._kept[name]

    def only(self, names: list) -> Ktn:
        """The same for these networks alone, with relations of their own."""
        k = Ktn(*self._from, "only")
        k._kept = {"scratch": k.scratch, "minima": self.minima.filter(F.col(NET).isin(names)), "ts": self.ts.filter(F.col(NET).isin(names))}
        return k

    def each(self, task, schema: str, joined, edges: bool = True) -> DataFrame:
        """network_id and ``schema``: task(net) of every network, made in one task from its minima and transition states (``single``).

        Networks beyond one task's limits, or with gaps, go through joined(ktn of them), which has the same columns.
        """
        far = graph._large(self.ts, single.MOST_TS)
        near = lambda df: graph.by_network(df.filter(F.col(NET).isNotNull() & ~F.col(NET).isin(far)) if far else df.filter(F.col(NET).isNotNull()))
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = near(self.minima).cogroup(near(self.ts)).applyInPandas(single.runner(task, columns, edges), f"{NET} string, {schema}, joined boolean")
        rows = self.scratch.put(rows, "each")
        far += [r[0] for r in rows.filter("joined").select(NET).collect()]
        rows = rows.filter("NOT joined").drop("joined")
        return rows.unionByName(joined(self.only(far))) if far else rows

    @property
    def minima(self) -> DataFrame:
        return self.keep("minima", lambda: ctmc.part_minima(*self._from))

    @property
    def ts(self) -> DataFrame:
        return self.keep("ts", lambda: ctmc.part_ts(*self._from))

    @property
    def rates(self) -> DataFrame:
        return self.keep("rates", lambda: ctmc.tst_rates(self.ts, self.minima))

    @property
    def nodes(self) -> DataFrame:
        return self.minima.select(NET, F.col("min_id").alias("node"))

    @property
    def ab(self) -> DataFrame:
        return ctmc.part_ab(self.minima)

    @property
    def states(self) -> DataFrame:
        must = self.ab.select(NET, F.col("min_id").alias("node"), F.lit(True).alias("m"))
        s = ctmc.equilibrium(self.minima).join(ctmc.waiting_times(self.rates).select(NET, "node", "tau"), [NET, "node"])
        return s.join(must, [NET, "node"], "left").select(NET, "node", "pi", "tau", F.coalesce("m", F.lit(False)).alias("must"))

    @property
    def components(self) -> DataFrame:
        return self.keep("components", lambda: graph.components(self.scratch, self.nodes, self.rates.select(NET, "src", "dst")))

    def connected(self):
        """The largest component of each network: (nodes, rates, ab of it)."""
        core = self.keep("core", lambda: graph.largest_component(self.components))
        m = self.minima.join(core.withColumnRenamed("node", "min_id"), [NET, "min_id"], "left_semi")
        r = self.rates.join(core.withColumnRenamed("node", "src"), [NET, "src"], "left_semi")
        return m, r, ctmc.part_ab(m)


def rnd(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def ktn_edge_barriers(spark, sf):
    k = Ktn(spark, sf, "k1")
    return rnd(ctmc.edge_barriers(k.ts, k.minima).select(NET, "ts_order", "f", "i", "barrier"), "barrier")


def ktn_barrier_min_pair(spark, sf):
    k = Ktn(spark, sf, "k2")
    return rnd(ctmc.pair_barriers(ctmc.edge_barriers(k.ts, k.minima)), "barrier")


def ktn_barrier_percentiles(spark, sf):
    k = Ktn(spark, sf, "k3")
    b = ctmc.edge_barriers(k.ts, k.minima)
    q = stats.quantiles(b, "barrier", [0.25, 0.5, 0.75, 0.9], [NET], k.scratch)
    return q.select(NET, *[F.round(f"q{i}", 6).alias(p) for i, p in enumerate(("p25", "p50", "p75", "p90"))])


def ktn_barrier_histogram(spark, sf):
    """60 equal bins over [0, 120)."""
    k = Ktn(spark, sf, "k4")
    b = ctmc.edge_barriers(k.ts, k.minima)
    return b.groupBy(NET, F.floor(F.col("barrier") / 2.0).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ktn_low_barrier_degree(spark, sf):
    k = Ktn(spark, sf, "k5")
    low = ctmc.edge_barriers(k.ts, k.minima).filter(F.col("barrier") <= CUT)
    e = graph.symmetrise(low.select(NET, F.col("f").alias("src"), F.col("i").alias("dst")))
    d = e.groupBy(NET, F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    return k.nodes.join(d, [NET, "node"], "left").fillna(0, ["deg"])


def ktn_components(spark, sf):
    return Ktn(spark, sf, "k6").components


def ktn_component_sizes(spark, sf):
    return rnd(graph.component_sizes(ktn_components(spark, sf)), "largest_frac")


def ktn_lcc(spark, sf):
    return graph.largest_component(ktn_components(spark, sf))


def ktn_basin_keep_set(spark, sf):
    k = Ktn(spark, sf, "k7")
    b = ctmc.edge_barriers(k.ts, k.minima)
    return graph.basin_keep_set(k.scratch, k.minima, b, k.ab, [CUT], 1.0).select(NET, "node")


def ktn_keep_sweep(spark, sf):
    k = Ktn(spark, sf, "k8")
    b = ctmc.edge_barriers(k.ts, k.minima)
    sets = graph.basin_keep_set(k.scratch, k.minima, b, k.ab, CUTS)
    return sets.groupBy(NET, "cut").agg(F.count("*").alias("n_keep"))


def ctmc_rates(spark, sf):
    return rnd(Ktn(spark, sf, "c1").rates, "k")


def ctmc_branching(spark, sf):
    return rnd(ctmc.branching(Ktn(spark, sf, "c2").rates).select(NET, "src", "dst", "b"), "b")


def ctmc_wait(spark, sf):
    return ctmc.waiting_times(Ktn(spark, sf, "c3").rates).select(NET, "node", F.round("escape", 6).alias("escape"), F.round(F.ln("tau"), 6).alias("log_tau"))


def ctmc_pi(spark, sf):
    return rnd(ctmc.equilibrium(ctmc.part_minima(spark, sf)), "pi", digits=9)


def ctmc_detailed_balance(spark, sf):
    k = Ktn(spark, sf, "c4")
    return ctmc.detailed_balance(k.rates, ctmc.equilibrium(k.minima)).select(NET, "edges", (F.col("worst") < 1e-10).cast("int").alias("ok"))


def ctmc_generator_sanity(spark, sf):
    k = Ktn(spark, sf, "c5")
    g = ctmc.generator_sanity(ctmc.generator(k.rates))
    return g.select(NET, "n", "nnz", F.round("nnz_per_state", 6).alias("nnz_per_state"), "diag_pos_count", "off_neg_count", (F.col("max_abs_colsum") < 1e-9).cast("int").alias("colsum_ok"), F.round("max_abs_rowsum", 6).alias("max_abs_rowsum"))


def ctmc_stationarity(spark, sf):
    k = Ktn(spark, sf, "c6")
    s = ctmc.stationarity(ctmc.generator(k.rates), ctmc.equilibrium(k.minima))
    return s.select(NET, F.round("absqpi_norm1", 6).alias("absqpi_norm1"), (F.col("qpi_rel") < 1e-10).cast("int").alias("ok"))


def ctmc_truncated(spark, sf):
    return rnd(ctmc.truncate(ctmc.part_minima(spark, sf), n_max=20, e_max=40.0), "energy")


def _keep(style, min_kept=10):
    def run(spark, sf):
        k = Ktn(spark, sf, f"keep_{style}")
        return ctmc.keep_states(k.states, style, 5.0, min_kept).select(NET, "node", F.col("kept").cast("int").alias("kept"))

    return run


def gt_eliminate_one(spark, sf):
    """The state with the longest wait of each network (ties: the least) removed: new log waiting times."""
    k = Ktn(spark, sf, "g1")
    w = ctmc.waiting_times(k.rates).select(NET, "node", "tau")
    x = w.groupBy(NET).agg(F.max(F.struct(F.round(F.ln("tau"), 9).alias("t"), (-F.col("node")).alias("n"))).alias("m")).select(NET, (-F.col("m.n")).alias("x"))
    b, t = reduce.eliminate_one(ctmc.branching(k.rates).select(NET, "src", "dst", "b"), w, x)
    total = b.groupBy(NET, F.col("src").alias("node")).agg(F.sum("b").alias("b_out"), F.count("*").alias("n_out"))
    return t.join(total, [NET, "node"], "left").select(NET, "node", F.round(F.ln("tau"), 6).alias("log_tau"), F.round(F.coalesce("b_out", F.lit(0.0)), 6).alias("b_out"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def _micro(k):
    """Each network's largest component: (minima, jump moments, waiting times, ab)."""
    m, r, ab = k.connected()
    w = ctmc.waiting_times(r).select(NET, "node", "tau")
    micro = k.keep("micro", lambda: reduce.jump_moments(ctmc.branching(r).select(NET, "src", "dst", "b"), w))
    return m, micro, w, k.keep("ab", lambda: ab)


def _reduced_of(k, percent=5.0, min_kept=50):
    """Each network's largest component, hybrid rule, reduced: (ktn, micro jump moments, reduced edges, ab)."""
    m, micro, w, ab = _micro(k)
    must = ab.select(NET, F.col("min_id").alias("node"), F.lit(True).alias("m"))
    s = ctmc.equilibrium(m).join(w, [NET, "node"]).join(must, [NET, "node"], "left").select(NET, "node", "pi", "tau", F.coalesce("m", F.lit(False)).alias("must"))
    s = k.scratch.put(s, "states")  # made once: sums made twice differ by rounding, and states at a cut would be above it
    chosen = k.keep(f"kept_{percent}_{min_kept}", lambda: ctmc.keep_states(s, "hybrid", percent, min_kept).filter("kept").select(NET, "node"))
    return k, micro, k.keep(f"reduced_{percent}_{min_kept}", lambda: reduce.transform(k.scratch, micro, chosen)), ab


def gt_reduce(spark, sf):
    """Reduced models: waiting time and branches of every kept state."""
    return Ktn(spark, sf, "g2").each(single.gt_reduce, "node long, tau_eff double, b_out double, n_out long", _kept_states)


def _kept_states(k):
    _, _, e, _ = _reduced_of(k)
    return e.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau_eff"), F.sum("p").alias("b_out"), F.count("*").alias("n_out"))


def gt_validate(spark, sf):
    """Passage times of the reduced models against the full ones: relative errors and flags per network."""
    cols = [f"{x}{c}" for c in ("", "_c") for x in ("mfpt_ab", "var_ab", "mfpt_ba", "var_ba")]
    j = Ktn(spark, sf, "g3").each(single.gt_validate, ", ".join(f"{c} double" for c in cols) + ", n_micro long, n_coarse long", _validated)
    err = lambda x: F.try_divide(F.abs(F.col(f"{x}_c") - F.col(x)), F.abs(F.col(x)))
    j = j.withColumns({"relerr_ab": err("mfpt_ab"), "relerr_ba": err("mfpt_ba"), "log10_ratio_ab": F.log10(F.col("mfpt_ab_c") / F.col("mfpt_ab"))})
    ok = (F.col("relerr_ab") <= 1e-6) & (F.col("relerr_ba") <= 1e-6)
    return j.withColumns({"compression": 1 - F.col("n_coarse") / F.col("n_micro"), "status": F.when(ok, "OK").when(ok.isNull(), "MISSING_COARSE_AB").otherwise("CHECK"), "gt_valid": F.coalesce(ok, F.lit(False)).cast("int")})


def _validated(k):
    k, micro, e, ab = _reduced_of(k)
    n = micro.select(NET, "src").distinct().groupBy(NET).agg(F.count("*").alias("n_micro"))
    c = e.select(NET, "src").distinct().groupBy(NET).agg(F.count("*").alias("n_coarse"))
    full = reduce.passage(k.scratch, micro, ab)
    part = reduce.passage(k.scratch, e, ab).select(NET, *[F.col(x).alias(f"{x}_c") for x in ("mfpt_ab", "var_ab", "mfpt_ba", "var_ba")])
    return full.join(part, NET).join(n, NET).join(c, NET)


def ab_kinetics(spark, sf):
    t = Ktn(spark, sf, "g4").each(single.ab_kinetics, ", ".join(f"{c} double" for c in ("mfpt_ab", "var_ab", "mfpt_ba", "var_ba")), _passage)
    return t.withColumns({"k_ab": F.try_divide(F.lit(1.0), "mfpt_ab"), "k_ba": F.try_divide(F.lit(1.0), "mfpt_ba"), "log10_mfpt_ab": F.log10("mfpt_ab"), "log10_mfpt_ba": F.log10("mfpt_ba")})


def _passage(k):
    _, micro, _, ab = _micro(k)
    return reduce.passage(k.scratch, micro, ab)


def committor_mfpt(spark, sf):
    """Committor and mean time to B of every state of each network's largest component."""
    return Ktn(spark, sf, "g5").each(single.committor_mfpt, "node long, committor double, mfpt_to_b double", _committors)


def _committors(k):
    _, micro, _, ab = _micro(k)
    return reduce.committor_all(k.scratch, micro, ab)


def spectrum(spark, sf):
    """The ten slowest modes of each network's largest component, none of its states removed."""
    return Ktn(spark, sf, "g6").each(single.spectrum, "mode int, lambda double, t double", lambda k: reduce.spectrum(_micro(k)[1]))


def spectral_features(spark, sf):
    """Features of the reduced networks, as in the reference."""
    names = ("gap", "gap_ratio", "gap_ratio_inv", "fiedler", "ramanujan_score", "entropy", "effective_dimension")
    return Ktn(spark, sf, "g8").each(single.spectral_features, ", ".join(f"{c} double" for c in names), _spectral)


def _spectral(k):
    k, _, e, _ = _reduced_of(k)
    return reduce.spectral_features(k.scratch.put(reduce.spectrum(e), "modes"), e)


def committor_sweeps(spark, sf):
    """Ten sweeps of q <- B q with q = 0 on A and 1 on B, from q = 0."""
    k = Ktn(spark, sf, "g7")
    b = k.scratch.put(ctmc.branching(k.rates).select(NET, "src", "dst", "b"), "b")
    side = k.ab.select(NET, F.col("min_id").alias("node"), (F.col("side") == "B").cast("double").alias("fix"))
    base = k.scratch.put(k.nodes.join(side, [NET, "node"], "left"), "base")
    q = base.select(NET, "node", F.coalesce("fix", F.lit(0.0)).alias("q"))
    for _ in range(10):
        got = b.join(q.withColumnRenamed("node", "dst"), [NET, "dst"]).groupBy(NET, F.col("src").alias("node")).agg(F.sum(F.col("b") * F.col("q")).alias("g"))
        q = k.scratch.put(base.join(got, [NET, "node"], "left").select(NET, "node", F.coalesce("fix", "g", F.lit(0.0)).alias("q")), "q", keep=2)
    return rnd(q, "q")


def pagerank_10(spark, sf):
    k = Ktn(spark, sf, "p1")
    return rnd(graph.pagerank(k.scratch, k.nodes, k.rates, 10), "r", digits=8)


def eigvec_centrality_10(spark, sf):
    k = Ktn(spark, sf, "p2")
    return rnd(graph.eigenvector_centrality(k.scratch, k.nodes, k.rates, 10), "r", digits=8)


def pagerank(spark, sf):
    """PageRank to 1e-8 within 200 steps, as in the reference."""
    k = Ktn(spark, sf, "p3")
    return graph.pagerank(k.scratch, k.nodes, k.rates, 200, tol=1e-8)


def eigvec_centrality(spark, sf):
    """The dominant eigenvector of each network's largest component, to 1e-10; its other nodes have 0."""
    k = Ktn(spark, sf, "p4")
    m, r, _ = k.connected()
    core = graph.eigenvector_centrality(k.scratch, m.select(NET, F.col("min_id").alias("node")), r, 1000, 1e-10)
    return k.nodes.join(core, [NET, "node"], "left").fillna(0.0, ["r"])


def _sources(k):
    return k.ab.select(NET, "side", F.col("min_id").alias("node"))


def hops_ab(spark, sf):
    k = Ktn(spark, sf, "h1")
    return graph.shortest(k.scratch, k.rates, _sources(k)).select(NET, "side", "node", F.col("dist").cast("long").alias("hops"))


def closeness_ab(spark, sf):
    k = Ktn(spark, sf, "h2")
    c = graph.closeness(graph.shortest(k.scratch, k.rates, _sources(k)))
    return c.select(NET, "side", "reached", F.col("hops").cast("long").alias("hops"), F.round("closeness", 8).alias("closeness"))


def sssp_branch(spark, sf):
    k = Ktn(spark, sf, "h3")
    return rnd(graph.shortest(k.scratch, graph.log_lengths(ctmc.branching(k.rates), "b"), _sources(k), "len"), "dist")


def sssp_rate(spark, sf):
    k = Ktn(spark, sf, "h4")
    return rnd(graph.shortest(k.scratch, graph.log_lengths(k.rates, "k"), _sources(k), "len"), "dist")


def sssp_barrier(spark, sf):
    k = Ktn(spark, sf, "h5")
    p = ctmc.pair_barriers(ctmc.edge_barriers(k.ts, k.minima))
    e = p.select(NET, F.col("u").alias("src"), F.col("v").alias("dst"), "barrier").union(p.select(NET, F.col("v").alias("src"), F.col("u").alias("dst"), "barrier"))
    return rnd(graph.shortest(k.scratch, e, _sources(k), "barrier"), "dist")


def path_features(spark, sf):
    """Hops of the shortest way from A to B and how many nodes lie on some way of at most twice as many."""
    k = Ktn(spark, sf, "h7")
    h = k.scratch.put(graph.shortest(k.scratch, k.rates, _sources(k)), "hops")
    a, b = h.filter("side = 'A'").select(NET, "node", F.col("dist").alias("da")), h.filter("side = 'B'").select(NET, "node", F.col("dist").alias("db"))
    goal = k.ab.filter("side = 'B'").select(NET, F.col("min_id").alias("node"))
    best = a.join(goal, [NET, "node"]).select(NET, F.col("da").cast("long").alias("hops"))
    near = a.join(b, [NET, "node"]).join(best, NET).groupBy(NET, "hops").agg(F.count_if(F.col("da") + F.col("db") <= 2 * F.col("hops")).alias("near_nodes"))
    return near


def topology_features(spark, sf):
    k = Ktn(spark, sf, "t1")
    t = graph.topology(k.nodes, k.rates).join(graph.assortativity(k.nodes, k.rates), NET, "left").fillna(0.0, ["assortativity"])
    return rnd(t, "deg_mean", "deg_median", "deg_std", "deg_skew", "density", "assortativity")


def triangles(spark, sf):
    k = Ktn(spark, sf, "t2")
    return rnd(graph.triangles(k.nodes, k.rates), "clustering")


def clustering_coeff(spark, sf):
    k = Ktn(spark, sf, "t3")
    t = graph.triangles(k.nodes, k.rates).groupBy(NET).agg(F.avg("clustering").alias("mean"), F.stddev_pop("clustering").alias("std"), (F.sum("triangles") / 3).cast("long").alias("triangles"))
    return rnd(t, "mean", "std")


def modularity(spark, sf):
    k = Ktn(spark, sf, "t4")
    lab = k.minima.select(NET, F.col("min_id").alias("node"), (F.col("min_id") % 4).alias("comp"))
    return rnd(graph.modularity(k.rates, lab), "modularity", "size_entropy", "largest_frac")


def community_features(spark, sf):
    """Communities as components of the graph of each node's fastest transition; their modularity and sizes."""
    k = Ktn(spark, sf, "t5")
    best = k.rates.groupBy(NET, "src").agg(F.max(F.struct(F.round("k", 9).alias("k"), (-F.col("dst")).alias("d"))).alias("m")).select(NET, "src", (-F.col("m.d")).alias("dst"))
    lab = graph.components(k.scratch, k.nodes, best)
    ab = k.ab.select(NET, F.col("min_id").alias("node"))
    same = lab.join(ab, [NET, "node"]).groupBy(NET).agg((F.count_distinct("comp") == 1).cast("int").alias("ab_same"))
    return rnd(graph.modularity(k.rates, lab).join(same, NET), "modularity", "size_entropy", "largest_frac")


def feature_row(spark, sf):
    """One wide row per network: sizes, topology, components, clustering and equilibrium weight of A and B."""
    k = Ktn(spark, sf, "t6")
    e = k.rates
    t = graph.topology(k.nodes, e).select(NET, "n", "edges_und", "density", "deg_mean", "deg_max")
    c = graph.component_sizes(k.components).select(NET, "n_components", "largest_frac")
    g = graph.triangles(k.nodes, e).groupBy(NET).agg(F.avg("clustering").alias("clustering_mean"))
    p = ctmc.equilibrium(k.minima).join(k.ab.select(NET, F.col("min_id").alias("node"), "side"), [NET, "node"])
    p = p.groupBy(NET).agg(F.sum(F.when(F.col("side") == "A", F.col("pi"))).alias("pi_a"), F.sum(F.when(F.col("side") == "B", F.col("pi"))).alias("pi_b"))
    full = t.join(c, NET, "left").join(g, NET, "left").join(p, NET, "left")
    missing = F.concat_ws(",", *[F.when(F.col(x).isNull(), F.lit(x)) for x in ("n_components", "clustering_mean", "pi_a")])
    full = full.withColumn("status", F.when(missing == "", "OK").otherwise(F.concat(F.lit("PARTIAL("), missing, F.lit(")"))))
    return rnd(full, "density", "deg_mean", "largest_frac", "clustering_mean", "pi_a", "pi_b")


QUERIES = {f.__name__: f for f in (
    ktn_edge_barriers, ktn_barrier_min_pair, ktn_barrier_percentiles, ktn_barrier_histogram, ktn_low_barrier_degree, ktn_components, ktn_component_sizes, ktn_lcc, ktn_basin_keep_set, ktn_keep_sweep,
    ctmc_rates, ctmc_branching, ctmc_wait, ctmc_pi, ctmc_detailed_balance, ctmc_generator_sanity, ctmc_stationarity, ctmc_truncated, gt_eliminate_one, gt_reduce, gt_validate, ab_kinetics, committor_mfpt, spectrum, spectral_features,
    committor_sweeps, pagerank_10, eigvec_centrality_10, pagerank, eigvec_centrality, hops_ab, closeness_ab, sssp_branch, sssp_rate, sssp_barrier, path_features, topology_features, triangles, clustering_coeff, modularity, community_features, feature_row,
)} | {f"keep_{s}": _keep(s) for s in ctmc.KEEP_STYLES} | {"keep_product": _keep(ctmc.PRODUCT, 50)}

_RULE = {"free_energy": "s.fe > c.fe_cut", "escape_time": "s.tau < c.tau_cut", "combined": "s.fe > c.fe_cut OR s.tau < c.tau_cut", "hybrid": "s.fe > c.fe_cut AND s.tau < c.tau_cut"}


def _keep_sql(style: str) -> str:
    return with_("cuts", more=f"""d AS (SELECT s.*, COALESCE(NOT s.must AND ({_RULE[style]}), FALSE) AS dropped FROM states s LEFT JOIN cuts c USING (network_id)),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id, dropped ORDER BY pi DESC, node) AS rn, COUNT(*) FILTER (WHERE NOT dropped) OVER (PARTITION BY network_id) AS n_kept FROM d)""") + "SELECT network_id, node, CAST(NOT dropped OR rn <= 10 - n_kept AS INT) AS kept FROM n"


def _chain_sql(prefix: str, first: str, step: str, names: int) -> list[str]:
    """Relations <prefix>0 .. <prefix><names>, each made of the one before ({p})."""
    return [f"{prefix}0 AS MATERIALIZED ({first})", *[f"{prefix}{i} AS MATERIALIZED ({step.format(p=f'{prefix}{i - 1}')})" for i in range(1, names + 1)]]


def _loop_sql(first: str, step: str, names: int, last: str, needs: list[str], more: str) -> str:
    ctes = [more] if more else []
    ctes += _chain_sql("x", first, step, names)
    return with_(*needs, more=",\n".join(ctes)) + last.format(p=f"x{names}")


_BASIN = """low AS (SELECT b.network_id, g.cut, b.f AS src, b.i AS dst FROM barriers b JOIN grid g ON b.barrier <= g.cut), lo2 AS MATERIALIZED (SELECT DISTINCT * FROM low UNION SELECT network_id, cut, dst, src FROM low),
br AS (SELECT n.network_id, g.cut, n.node AS root, n.node FROM nodes n CROSS JOIN grid g UNION SELECT r.network_id, r.cut, r.root, l.dst FROM br r JOIN lo2 l ON l.network_id = r.network_id AND l.cut = r.cut AND l.src = r.node),
bc AS (SELECT network_id, cut, node, MIN(root) AS comp FROM br GROUP BY 1, 2, 3),
reps AS (SELECT network_id, cut, node FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.network_id, c.cut, c.comp ORDER BY m.energy, m.min_id) AS rn FROM bc c JOIN minima m ON m.network_id = c.network_id AND m.min_id = c.node) WHERE rn = 1),
kept AS (SELECT network_id, cut, node FROM reps UNION SELECT a.network_id, g.cut, a.min_id FROM ab a CROSS JOIN grid g UNION SELECT network_id, cut, min_id FROM (SELECT m.*, MIN(energy) OVER (PARTITION BY network_id) AS e0 FROM minima m) CROSS JOIN grid WHERE energy - e0 <= {window})"""
# breadth-first levels as a chain: each level holds the nodes not met before
_CHAIN = "l0 AS MATERIALIZED (SELECT network_id, side, min_id AS node, 0 AS hops FROM ab), a0 AS MATERIALIZED (SELECT * FROM l0)"
for _i in range(1, 41):
    _CHAIN += f""",
l{_i} AS MATERIALIZED (SELECT DISTINCT l.network_id, l.side, u.dst AS node, {_i} AS hops FROM l{_i - 1} l JOIN und u ON u.network_id = l.network_id AND u.src = l.node ANTI JOIN a{_i - 1} s ON s.network_id = l.network_id AND s.side = l.side AND s.node = u.dst),
a{_i} AS MATERIALIZED (SELECT * FROM a{_i - 1} UNION ALL SELECT * FROM l{_i})"""
_CHAIN += ",\nhops AS (SELECT * FROM a40)"

_TRI = """deg3 AS (SELECT n.network_id, n.node, COUNT(*) AS t2 FROM nodes n JOIN und a ON a.network_id = n.network_id AND a.src = n.node JOIN und b ON b.network_id = n.network_id AND b.src = a.dst JOIN und c ON c.network_id = n.network_id AND c.src = b.dst AND c.dst = n.node GROUP BY 1, 2),
tri AS MATERIALIZED (SELECT d.network_id, d.node, COALESCE(t.t2, 0) // 2 AS triangles, CASE WHEN d.deg > 1 THEN 1.0 * COALESCE(t.t2, 0) / (d.deg * (d.deg - 1)) ELSE 0.0 END AS clustering FROM deg d LEFT JOIN deg3 t USING (network_id, node))"""
_MOD = """cin AS (SELECT u.network_id, a.comp AS ca, SUM(CASE WHEN a.comp = b.comp THEN 1.0::DOUBLE ELSE 0 END) AS inside, COUNT(*)::DOUBLE AS deg FROM und u JOIN lab a ON a.network_id = u.network_id AND a.node = u.src JOIN lab b ON b.network_id = u.network_id AND b.node = u.dst GROUP BY 1, 2),
m2 AS (SELECT network_id, COUNT(*)::DOUBLE AS m2 FROM und GROUP BY 1), mq AS (SELECT c.network_id, SUM(inside / m2 - (deg / m2) * (deg / m2)) AS modularity FROM cin c JOIN m2 USING (network_id) GROUP BY 1),
sz AS (SELECT network_id, comp, COUNT(*) AS n FROM lab GROUP BY 1, 2), sp AS (SELECT network_id, n / SUM(n) OVER (PARTITION BY network_id) AS p FROM sz),
sq AS (SELECT network_id, COUNT(*) AS n_communities, -SUM(p * LN(p + 1e-300)) AS size_entropy, MAX(p) AS largest_frac FROM sp GROUP BY 1)"""
_TOPO = """topo AS (SELECT network_id, COUNT(*) AS n, CAST(SUM(deg) AS BIGINT) AS edges_dir, CAST(SUM(deg) // 2 AS BIGINT) AS edges_und, AVG(deg) AS deg_mean, quantile_cont(deg, 0.5) AS deg_median, MIN(deg) AS deg_min, MAX(deg) AS deg_max, STDDEV_POP(deg) AS deg_std,
 (AVG(deg::DOUBLE ** 3) - 3 * AVG(deg) * AVG(deg::DOUBLE ** 2) + 2 * AVG(deg) ** 3) / NULLIF(STDDEV_POP(deg), 0) ** 3 AS deg_skew, 2.0 * (SUM(deg) // 2) / (COUNT(*) * (COUNT(*) - 1)) AS density FROM deg GROUP BY 1)"""


def _sssp_sql(edges: str, needs: list[str]) -> str:
    """Bellman-Ford rounds; 60 are enough for the shortest ways here."""
    step = "SELECT network_id, side, node, MIN(dist) AS dist FROM (SELECT * FROM {p} UNION ALL SELECT d.network_id, d.side, e.dst, d.dist + e.len FROM {p} d JOIN le e ON e.network_id = d.network_id AND e.src = d.node) GROUP BY 1, 2, 3"
    return _loop_sql("SELECT network_id, side, min_id AS node, 0.0::DOUBLE AS dist FROM ab", step, 60, "SELECT network_id, side, node, ROUND(dist, 6) AS dist FROM {p}", [*needs, "ab"], edges)


def _len(value: str, source: str) -> str:
    return f"le0 AS (SELECT network_id, src, dst, -LN(GREATEST({value}, 1e-300)) AS len FROM {source}), le AS MATERIALIZED (SELECT e.network_id, src, dst, len - low AS len FROM le0 e JOIN (SELECT network_id, LEAST(0.0, MIN(len)) AS low FROM le0 GROUP BY 1) l ON l.network_id = e.network_id)"


SQL = {
    "ktn_edge_barriers": with_("barriers") + "SELECT network_id, ts_order, f, i, ROUND(barrier, 6) AS barrier FROM barriers",
    "ktn_barrier_min_pair": with_("barriers") + "SELECT network_id, LEAST(f, i) AS u, GREATEST(f, i) AS v, ROUND(MIN(barrier), 6) AS barrier FROM barriers GROUP BY 1, 2, 3",
    "ktn_barrier_percentiles": with_("barriers") + "SELECT network_id, " + ", ".join(f"ROUND(quantile_cont(barrier, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90)) + " FROM barriers GROUP BY 1",
    "ktn_barrier_histogram": with_("barriers") + "SELECT network_id, CAST(FLOOR(barrier / 2.0) AS BIGINT) AS bin, COUNT(*) AS n FROM barriers GROUP BY 1, 2",
    "ktn_low_barrier_degree": with_("barriers", "nodes", more=f"l AS (SELECT DISTINCT network_id, f AS src, i AS dst FROM barriers WHERE barrier <= {CUT}), l2 AS (SELECT * FROM l UNION SELECT network_id, dst, src FROM l)") + "SELECT n.network_id, n.node, COUNT(l2.dst) AS deg FROM nodes n LEFT JOIN l2 ON l2.network_id = n.network_id AND l2.src = n.node GROUP BY 1, 2",
    "ktn_components": with_("comp") + "SELECT network_id, node, comp FROM comp",
    "ktn_component_sizes": with_("comp", more="s AS (SELECT network_id, comp, COUNT(*) AS n FROM comp GROUP BY 1, 2)") + "SELECT network_id, COUNT(*) AS n_components, CAST(SUM(n) AS BIGINT) AS n_nodes, MAX(n) AS largest, ROUND(MAX(n) / SUM(n), 6) AS largest_frac FROM s GROUP BY 1",
    "ktn_lcc": with_("comp", more="s AS (SELECT network_id, comp, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY COUNT(*) DESC, comp) AS rn FROM comp GROUP BY 1, 2)") + "SELECT c.network_id, c.node FROM comp c JOIN s ON s.network_id = c.network_id AND s.comp = c.comp WHERE rn = 1",
    "ktn_basin_keep_set": with_("barriers", "nodes", "ab", more=f"grid AS (SELECT {CUT}::DOUBLE AS cut),\n" + _BASIN.replace("{window}", "1.0")) + "SELECT network_id, node FROM kept",
    "ktn_keep_sweep": with_("barriers", "nodes", "ab", more="grid AS (SELECT unnest([1.0, 3.0, 9.0, 27.0])::DOUBLE AS cut),\n" + _BASIN.replace("{window}", "0.0")) + "SELECT network_id, cut, COUNT(*) AS n_keep FROM kept GROUP BY 1, 2",
    "ctmc_rates": with_("rates") + "SELECT network_id, src, dst, ROUND(k, 6) AS k FROM rates",
    "ctmc_branching": with_("branch") + "SELECT network_id, src, dst, ROUND(b, 6) AS b FROM branch",
    "ctmc_wait": with_("wait") + "SELECT network_id, node, ROUND(escape, 6) AS escape, ROUND(LN(tau), 6) AS log_tau FROM wait",
    "ctmc_pi": with_("pi") + "SELECT network_id, node, ROUND(pi, 9) AS pi FROM pi",
    "ctmc_detailed_balance": with_("rates", "pi") + "SELECT r.network_id, COUNT(*) AS edges, CAST(MAX(ABS(p.pi * r.k - COALESCE(b.k * q.pi, 0)) / (p.pi * r.k)) < 1e-10 AS INT) AS ok FROM rates r JOIN pi p ON p.network_id = r.network_id AND p.node = r.src LEFT JOIN rates b ON b.network_id = r.network_id AND b.src = r.dst AND b.dst = r.src LEFT JOIN pi q ON q.network_id = r.network_id AND q.node = r.dst GROUP BY 1",
    "ctmc_generator_sanity": with_("q") + "SELECT c.network_id, c.n, s.nnz, ROUND(s.nnz / c.n, 6) AS nnz_per_state, s.diag_pos_count, s.off_neg_count, CAST(c.m < 1e-9 AS INT) AS colsum_ok, ROUND(r.m, 6) AS max_abs_rowsum FROM (SELECT network_id, COUNT(*) AS n, MAX(ABS(s)) AS m FROM (SELECT network_id, src, SUM(q) AS s FROM q GROUP BY 1, 2) GROUP BY 1) c JOIN (SELECT network_id, MAX(ABS(s)) AS m FROM (SELECT network_id, dst, SUM(q) AS s FROM q GROUP BY 1, 2) GROUP BY 1) r ON r.network_id = c.network_id JOIN (SELECT network_id, COUNT(*) AS nnz, COUNT(*) FILTER (WHERE src = dst AND q > 1e-12) AS diag_pos_count, COUNT(*) FILTER (WHERE src <> dst AND q < -1e-12) AS off_neg_count FROM q GROUP BY 1) s ON s.network_id = c.network_id",
    "ctmc_stationarity": with_("q", "pi") + "SELECT network_id, ROUND(SUM(b), 6) AS absqpi_norm1, CAST(SUM(ABS(a)) / SUM(b) < 1e-10 AS INT) AS ok FROM (SELECT q.network_id, q.dst, SUM(q.q * p.pi) AS a, SUM(ABS(q.q) * p.pi) AS b FROM q JOIN pi p ON p.network_id = q.network_id AND p.node = q.src GROUP BY 1, 2) GROUP BY 1",
    "ctmc_truncated": with_("minima") + "SELECT network_id, min_id, ROUND(energy, 6) AS energy, log_prod FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY energy, min_id) AS rn FROM (SELECT *, MIN(energy) OVER (PARTITION BY network_id) AS low FROM minima) WHERE energy - low <= 40) WHERE rn <= 20",
    **{f"keep_{s}": _keep_sql(s) for s in ctmc.KEEP_STYLES},
    "gt_eliminate_one": with_("branch", more="""v AS (SELECT network_id, node AS x, tau AS tx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY ROUND(LN(tau), 9) DESC, node) AS rn FROM wait) WHERE rn = 1),
d AS (SELECT b.network_id, SUM(b.b) AS d FROM branch b JOIN v ON v.network_id = b.network_id AND b.src = v.x GROUP BY 1),
nb AS (SELECT network_id, src, dst, SUM(b) AS b FROM (SELECT b.network_id, src, dst, b FROM branch b JOIN v ON v.network_id = b.network_id WHERE src <> x AND dst <> x
UNION ALL SELECT i.network_id, i.src, o.dst, i.b * o.b / d.d FROM branch i JOIN v ON v.network_id = i.network_id AND i.dst = v.x JOIN branch o ON o.network_id = i.network_id AND o.src = v.x JOIN d ON d.network_id = i.network_id) GROUP BY 1, 2, 3),
s AS (SELECT network_id, src, SUM(b) AS b_out, COUNT(*) AS n_out FROM nb GROUP BY 1, 2)""") + "SELECT w.network_id, w.node, ROUND(LN(w.tau + COALESCE(i.b * v.tx / d.d, 0)), 6) AS log_tau, ROUND(COALESCE(s.b_out, 0), 6) AS b_out, COALESCE(s.n_out, 0) AS n_out FROM wait w JOIN v ON v.network_id = w.network_id JOIN d ON d.network_id = w.network_id LEFT JOIN branch i ON i.network_id = w.network_id AND i.src = w.node AND i.dst = v.x LEFT JOIN s ON s.network_id = w.network_id AND s.src = w.node WHERE w.node <> v.x",
    "committor_sweeps": _loop_sql("SELECT n.network_id, n.node, COALESCE(CASE side WHEN 'B' THEN 1.0::DOUBLE WHEN 'A' THEN 0 END, 0) AS q FROM nodes n LEFT JOIN ab ON ab.network_id = n.network_id AND ab.min_id = n.node",
        "SELECT n.network_id, n.node, CASE ab.side WHEN 'B' THEN 1.0::DOUBLE WHEN 'A' THEN 0 ELSE COALESCE(g.g, 0) END AS q FROM nodes n LEFT JOIN ab ON ab.network_id = n.network_id AND ab.min_id = n.node LEFT JOIN (SELECT b.network_id, b.src, SUM(b.b * p.q) AS g FROM branch b JOIN {p} p ON p.network_id = b.network_id AND p.node = b.dst GROUP BY 1, 2) g ON g.network_id = n.network_id AND g.src = n.node",
        10, "SELECT network_id, node, ROUND(q, 6) AS q FROM {p}", ["branch", "nodes", "ab"], ""),
    "pagerank_10": _loop_sql("SELECT network_id, node, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY network_id) AS r FROM nodes",
        "SELECT network_id, node, x / SUM(x) OVER (PARTITION BY network_id) AS r FROM (SELECT n.network_id, n.node, 0.15 / COUNT(*) OVER (PARTITION BY n.network_id) + 0.85 * COALESCE(g.g, 0) AS x FROM nodes n LEFT JOIN (SELECT b.network_id, b.dst, SUM(b.b * p.r) AS g FROM branch b JOIN {p} p ON p.network_id = b.network_id AND p.node = b.src GROUP BY 1, 2) g ON g.network_id = n.network_id AND g.dst = n.node)",
        10, "SELECT network_id, node, ROUND(r, 8) AS r FROM {p}", ["branch", "nodes"], ""),
    "eigvec_centrality_10": _loop_sql("SELECT network_id, node, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY network_id) AS r FROM nodes",
        "SELECT network_id, node, x / SUM(x) OVER (PARTITION BY network_id) AS r FROM (SELECT n.network_id, n.node, n.r + COALESCE(g.g, 0) AS x FROM {p} n LEFT JOIN (SELECT u.network_id, u.dst, SUM(p.r) AS g FROM und u JOIN {p} p ON p.network_id = u.network_id AND p.node = u.src GROUP BY 1, 2) g ON g.network_id = n.network_id AND g.dst = n.node)",
        10, "SELECT network_id, node, ROUND(r, 8) AS r FROM {p}", ["und", "nodes"], ""),
    "hops_ab": with_("und", "ab", more=_CHAIN) + "SELECT network_id, side, node, CAST(hops AS BIGINT) AS hops FROM hops",
    "closeness_ab": with_("und", "ab", more=_CHAIN) + "SELECT network_id, side, COUNT(*) FILTER (WHERE hops > 0) AS reached, CAST(SUM(hops) AS BIGINT) AS hops, ROUND(COUNT(*) FILTER (WHERE hops > 0) / NULLIF(SUM(hops), 0), 8) AS closeness FROM hops GROUP BY 1, 2",
    "sssp_branch": _sssp_sql(_len("b", "branch"), ["branch"]),
    "sssp_rate": _sssp_sql(_len("k", "rates"), ["rates"]),
    "sssp_barrier": _sssp_sql("pb AS (SELECT network_id, LEAST(f, i) AS u, GREATEST(f, i) AS v, MIN(barrier) AS len FROM barriers GROUP BY 1, 2, 3), le AS MATERIALIZED (SELECT network_id, u AS src, v AS dst, len FROM pb UNION ALL SELECT network_id, v, u, len FROM pb)", ["barriers"]),
    "path_features": with_("und", "ab", more=_CHAIN) + "SELECT a.network_id, t.hops, COUNT(*) FILTER (WHERE a.hops + b.hops <= 2 * t.hops) AS near_nodes FROM hops a JOIN hops b ON b.network_id = a.network_id AND b.node = a.node AND b.side = 'B' JOIN (SELECT h.network_id, CAST(h.hops AS BIGINT) AS hops FROM hops h JOIN ab ON ab.network_id = h.network_id AND ab.min_id = h.node AND ab.side = 'B' WHERE h.side = 'A') t ON t.network_id = a.network_id WHERE a.side = 'A' GROUP BY 1, 2",
    "topology_features": with_("deg", more=_TOPO + """,
asr AS (SELECT u.network_id, CORR(a.deg, b.deg) AS r FROM und u JOIN deg a ON a.network_id = u.network_id AND a.node = u.src JOIN deg b ON b.network_id = u.network_id AND b.node = u.dst GROUP BY 1)""") + "SELECT t.network_id, n, edges_dir, edges_und, ROUND(deg_mean, 6) AS deg_mean, ROUND(deg_median, 6) AS deg_median, deg_min, deg_max, ROUND(deg_std, 6) AS deg_std, ROUND(deg_skew, 6) AS deg_skew, ROUND(density, 6) AS density, ROUND(COALESCE(CASE WHEN isnan(r) THEN 0 ELSE r END, 0), 6) AS assortativity FROM topo t LEFT JOIN asr ON asr.network_id = t.network_id",
    "triangles": with_("deg", more=_TRI) + "SELECT network_id, node, CAST(triangles AS BIGINT) AS triangles, ROUND(clustering, 6) AS clustering FROM tri",
    "clustering_coeff": with_("deg", more=_TRI) + "SELECT network_id, ROUND(AVG(clustering), 6) AS mean, ROUND(STDDEV_POP(clustering), 6) AS std, CAST(SUM(triangles) // 3 AS BIGINT) AS triangles FROM tri GROUP BY 1",
    "modularity": with_("und", "minima", more="lab AS (SELECT network_id, min_id AS node, min_id % 4 AS comp FROM minima),\n" + _MOD) + "SELECT s.network_id, n_communities, ROUND(size_entropy, 6) AS size_entropy, ROUND(largest_frac, 6) AS largest_frac, ROUND(modularity, 6) AS modularity FROM sq s LEFT JOIN mq ON mq.network_id = s.network_id",
    "feature_row": with_("deg", "comp", "pi", "ab", more=_TOPO + ",\n" + _TRI + ",\ncs AS (SELECT network_id, comp, COUNT(*) AS n FROM comp GROUP BY 1, 2), cc AS (SELECT network_id, COUNT(*) AS n_components, MAX(n) / SUM(n) AS largest_frac FROM cs GROUP BY 1), cl AS (SELECT network_id, AVG(clustering) AS clustering_mean FROM tri GROUP BY 1), pp AS (SELECT p.network_id, SUM(CASE WHEN side = 'A' THEN pi END) AS pi_a, SUM(CASE WHEN side = 'B' THEN pi END) AS pi_b FROM pi p JOIN ab ON ab.network_id = p.network_id AND ab.min_id = p.node GROUP BY 1)") + "SELECT t.network_id, n, edges_und, ROUND(density, 6) AS density, ROUND(deg_mean, 6) AS deg_mean, deg_max, n_components, ROUND(largest_frac, 6) AS largest_frac, ROUND(clustering_mean, 6) AS clustering_mean, ROUND(pi_a, 6) AS pi_a, ROUND(pi_b, 6) AS pi_b, 'OK' AS status FROM topo t JOIN cc USING (network_id) JOIN cl USING (network_id) JOIN pp USING (network_id)",
}
