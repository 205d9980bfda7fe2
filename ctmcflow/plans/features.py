"""Queries of the feature groups, tensors, derived models and set kinetics of networks, and the same in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window, functions as F

from ctmcflow.functions import sequence as seq
from ctmcflow.operators import ctmc, features, graph, reduce, single
from ctmcflow.operators.graph import NET
from ctmcflow.plans.networks import CUTS, Ktn, _chain_sql, _len, _micro, _reduced_of, rnd, with_


def micro_model(spark, sf, label: str) -> tuple[Ktn, features.Model]:
    """The whole networks as they are."""
    k = Ktn(spark, sf, label)
    b = k.scratch.put(ctmc.branching(k.rates).select(NET, "src", "dst", "b"), "branches")
    p = ctmc.pair_barriers(ctmc.edge_barriers(k.ts, k.minima))
    ab = k.scratch.put(k.ab, "ab")
    return k, features.Model(k.scratch, k.nodes, k.rates, b, k.scratch.put(ctmc.equilibrium(k.minima), "pi"), ab, b, k.scratch.put(p, "pairs"))


def coarse_of(k: Ktn) -> tuple[Ktn, features.Model]:
    """Each network's largest component, reduced by the hybrid rule."""
    k, micro, e, ab = _reduced_of(k)
    nodes = micro.select(NET, F.col("src").alias("min_id")).distinct()
    m = k.minima.join(nodes, [NET, "min_id"], "left_semi")
    tau = micro.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau"))
    pi = k.scratch.put(reduce.stationary(e, ctmc.equilibrium(m), tau).select(NET, "node", F.col("pi_eff").alias("pi")), "pi_eff")
    return k, features.reduced_model(k.scratch, e, pi, ab)


_DIST = [f"{n}_dist_{w}_{k}" for n in ("branch", "rate") for w in ("ab", "ba") for k in ("min", "mean")] + [f"{n}_dist_asymmetry" for n in ("branch", "rate")] + ["barrier_dist_ab_min", "barrier_dist_ab_mean"]


def distance_features(spark, sf):
    """The 12 lengths between A and B by branching, rate and barrier."""
    _, m = micro_model(spark, sf, "f1")
    return rnd(features.distance(m), *_DIST)


def centrality_features(spark, sf):
    _, m = micro_model(spark, sf, "f2")
    return features.centrality(m)


def path_features_ab(spark, sf):
    _, m = micro_model(spark, sf, "f3")
    p = features.path(m)
    return p.select(NET, F.col("shortest_path_hops_ab").cast("long").alias("shortest_path_hops_ab"), F.round("rate_shortest_path_ab", 6).alias("rate_shortest_path_ab"), F.col("n_short_pairs_ab").cast("long").alias("n_short_pairs_ab"), "path_redundancy")


def spectral_communities(spark, sf):
    """Communities of the reduced networks by eigengap and spectral clustering, with their modularity."""
    schema = "n_communities long, community_size_entropy double, largest_community_frac double, modularity double, ab_same_community int"
    return Ktn(spark, sf, "f4").each(single.spectral_communities, schema, lambda k: features.communities(coarse_of(k)[1]))


def graph_features(spark, sf):
    """The wide row of all seven groups (65 features) of every reduced network, with status."""
    return _row(Ktn(spark, sf, "f5"), features.ALL)


def _row(k: Ktn, groups: tuple[str, ...]) -> DataFrame:
    """The groups of features with a network in one task; those of its name are columns."""
    schema = ", ".join(GROUPS[g] for g in groups if g in GROUPS) + ", status string"
    x = k.each(partial(single.graph_features, groups=groups), schema, lambda far: features.feature_row(coarse_of(far)[1], groups).select(NET, *_names(schema, 0, None)))
    name = seq.composition(F.split_part(F.col(NET), F.lit("_"), F.lit(1))) if "sequence" in groups else {}
    return x.select(NET, *[c.alias(n) for n, c in name.items()], *_names(schema, 0, None))


GROUPS = {
    "distance": ", ".join(f"{c} double" for n in ("branch", "rate") for c in [*(f"{n}_dist_{w}_{k}" for w in ("ab", "ba") for k in ("min", "mean")), f"{n}_dist_asymmetry"]) + ", barrier_dist_ab_min double, barrier_dist_ab_mean double",
    "spectral": ", ".join(f"spectral_{c} double" for c in ("gap", "gap_ratio", "gap_ratio_inv", "fiedler", "ramanujan_score", "entropy", "effective_dimension")),
    "centrality": ", ".join(f"{c} double" for c in ("pi_a", "pi_b", "pi_ratio_ab", "pagerank_a", "pagerank_b", "eigvec_centrality_a", "eigvec_centrality_b", "closeness_centrality_a", "closeness_centrality_b")),
    "community": "n_communities long, community_size_entropy double, largest_community_frac double, modularity double, ab_same_community int",
    "path": "shortest_path_hops_ab double, rate_shortest_path_ab double, n_short_pairs_ab long, path_redundancy double",
    "topology": "n_nodes long, n_edges_directed long, n_edges_undirected long, density double, degree_mean double, degree_std double, degree_max long, degree_min long, degree_skew double, degree_assortativity double, n_components long, largest_component_frac double, clustering_coeff_mean double, clustering_coeff_std double",
}


def graph_features_lite(spark, sf):
    """The preset of five groups, without communities and paths."""
    return _row(Ktn(spark, sf, "f6"), features.LITE)


def node_tensor(spark, sf):
    k = Ktn(spark, sf, "f7")
    t = features.node_tensor(k.minima, k.rates, k.ab)
    return rnd(t, *[c for c in t.columns if c not in (NET, "node", "is_a", "is_b")], digits=5)


def edge_tensor(spark, sf):
    return rnd(features.edge_tensor(Ktn(spark, sf, "f8").rates), "z_fwd", "z_rev", "b", digits=5)


def node_enrichment(spark, sf):
    k = Ktn(spark, sf, "f9")
    t = features.node_enrichment(k.scratch.put(features.edge_tensor(k.rates), "edges"), k.nodes)
    return rnd(t, *[c for c in t.columns if c not in (NET, "node")], digits=5)


def branches_from_generator(spark, sf):
    """B out of Q, as where no B was kept."""
    k = Ktn(spark, sf, "f10")
    b = ctmc.branches_from_generator(ctmc.generator(k.rates), ctmc.waiting_times(k.rates))
    return rnd(b, "b", digits=8)


def generator_from_rates(spark, sf):
    """Q out of K and the waiting times, as where no Q was kept: its diagonal and its sums by source."""
    k = Ktn(spark, sf, "f11")
    q = ctmc.generator_from_rates(k.rates, ctmc.waiting_times(k.rates))
    return q.groupBy(NET, F.col("src").alias("node")).agg(F.count("*").alias("entries"), F.round(F.max(F.when(F.col("src") == F.col("dst"), F.col("q"))), 6).alias("diagonal"), (F.abs(F.sum("q")) < 1e-9).cast("int").alias("sums_to_zero"))


def dense_index(spark, sf):
    """Places 0.. of the states of each network in the order of their numbers, also of A and B; null for states that are not kept."""
    k = Ktn(spark, sf, "f12")
    kept = ctmc.keep_states(k.states, "hybrid", 5.0, 10).filter("kept").select(NET, "node")
    at = kept.withColumn("place", F.row_number().over(Window.partitionBy(NET).orderBy("node")).cast("long") - 1)
    return k.ab.select(NET, F.col("min_id").alias("node"), "side").join(at, [NET, "node"], "full").select(NET, "node", "side", "place")


def gt_stationary(spark, sf):
    """Stationary distribution of the reduced models: relative residuals of the restricted and of the exact one, and which is used."""
    x = Ktn(spark, sf, "f13").each(single.gt_stationary, "n_eff long, rel_pi_restricted double, rel_pi_eff double", _stationary)
    return x.withColumn("used", F.when(F.col("rel_pi_restricted") <= 1e-10, "restricted").otherwise("solved"))


def _stationary(k: Ktn) -> DataFrame:
    k, micro, e, _ = _reduced_of(k)
    tau = micro.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau"))
    m = k.minima.join(tau.select(NET, F.col("node").alias("min_id")), [NET, "min_id"], "left_semi")
    x = k.scratch.put(reduce.stationary(e, ctmc.equilibrium(m), tau), "pi_eff")
    q = k.scratch.put(reduce.reduced_generator(e), "q_eff")
    r = {c: ctmc.stationarity(q, x.select(NET, "node", F.col(c).alias("pi"))).select(NET, F.col("qpi_rel").alias(f"rel_{c}")) for c in ("pi_restricted", "pi_eff")}
    n = x.groupBy(NET).agg(F.count("*").alias("n_eff"))
    return n.join(r["pi_restricted"], NET).join(r["pi_eff"], NET)


def _sets(m: DataFrame, n: int = 3) -> DataFrame:
    """A: the n lowest states of a network, B: the n next ones."""
    w = Window.partitionBy(NET).orderBy("energy", "min_id")
    return m.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2 * n).select(NET, "min_id", F.when(F.col("rn") <= n, "A").otherwise("B").alias("side"))


def ab_set_kinetics(spark, sf):
    """Passage times and rates between sets of three states each."""
    schema = "n_a long, n_b long, " + ", ".join(f"{c}_{w} double" for w in ("ab", "ba") for c in ("mfpt", "k_ss", "k_nss", "k_f", "k_star"))
    return Ktn(spark, sf, "f14").each(single.ab_set_kinetics, schema, _set_kinetics, edges=False)


def _set_kinetics(k: Ktn) -> DataFrame:
    m, micro, _, _ = _micro(k)
    return reduce.set_kinetics(k.scratch, micro, k.scratch.put(ctmc.equilibrium(m), "pi"), k.scratch.put(_sets(m), "sets"))


def micro_report_built(spark, sf):
    """The report row of every network, made from it: sizes, pi, checks of the generator, stationarity, A and B, passage times, status."""
    return _status(Ktn(spark, sf, "f15").each(single.micro_report_built, REPORT, _report)).select(NET, *_names(REPORT, 0, -4), "status", *_names(REPORT, -4, None))


REPORT = "max_abs_colsum double, n long, max_abs_rowsum double, nnz long, diag_pos_count long, off_neg_count long, nnz_per_state double, pi_sum double, pi_min double, pi_max double, qpi_norm1 double, absqpi_norm1 double, qpi_rel double, na long, nb long, ab_overlap long, a_index long, b_index long, mfpt_ab double, var_ab double, mfpt_ba double, var_ba double"


def _names(schema: str, start: int, end: int | None) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")][start:end]


def _report(k: Ktn) -> DataFrame:
    _, micro, _, ab = _micro(k)
    core = _report_core(k).drop("status")
    t = reduce.passage(k.scratch, micro, ab)
    return core.join(t, NET, "left")


def _report_core(k: Ktn) -> DataFrame:
    q = k.scratch.put(ctmc.generator(k.rates), "q")
    pi = k.scratch.put(ctmc.equilibrium(k.minima), "pi")
    p = pi.groupBy(NET).agg(F.sum("pi").alias("pi_sum"), F.min("pi").alias("pi_min"), F.max("pi").alias("pi_max"))
    side = k.ab.groupBy(NET, "min_id").agg(F.count_distinct("side").alias("s"), F.max(F.col("side") == "A").alias("a"), F.max(F.col("side") == "B").alias("b"))
    one = lambda s: F.when(F.count_if(F.col(s)) == 1, F.max(F.when(F.col(s), F.col("min_id"))))
    ab = side.groupBy(NET).agg(F.count_if(F.col("a")).alias("na"), F.count_if(F.col("b")).alias("nb"), F.count_if(F.col("s") > 1).alias("ab_overlap"), one("a").alias("a_index"), one("b").alias("b_index"))
    return _status(ctmc.generator_sanity(q).join(p, NET).join(ctmc.stationarity(q, pi), NET).join(ab, NET, "left"))


def _status(r: DataFrame) -> DataFrame:
    ok = (F.col("off_neg_count") == 0) & (F.col("diag_pos_count") == 0) & (F.col("qpi_rel") < 1e-10)
    return r.withColumn("status", F.when(ok, "OK").otherwise("CHECK"))


def micro_report_core(spark, sf):
    """The report row without passage times."""
    r = _report_core(Ktn(spark, sf, "f16"))
    return r.select(NET, "n", "nnz", F.round("nnz_per_state", 6).alias("nnz_per_state"), F.round("pi_sum", 9).alias("pi_sum"), F.round("pi_max", 9).alias("pi_max"), "diag_pos_count", "off_neg_count", F.round("absqpi_norm1", 6).alias("absqpi_norm1"),
        (F.col("qpi_rel") < 1e-10).cast("int").alias("stationary_ok"), "na", "nb", "ab_overlap", "a_index", "b_index", "status")


def robustness_grid(spark, sf):
    """Reduced models over a grid of barrier cuts: kept states, passage times and the five slowest relaxation times of each."""
    schema = "n_eff long, mfpt_ab double, mfpt_ba double, " + ", ".join(f"t_relax_{i} double" for i in range(1, 6)) + ", cut double"
    return Ktn(spark, sf, "f17").each(partial(single.robustness_grid, cuts=CUTS), schema, _grid)


def _grid(k: Ktn) -> DataFrame:
    """All cuts of all networks are transformed in one plan: a network and a cut make a network of their own."""
    m, micro, _, ab = _micro(k)
    b = ctmc.edge_barriers(k.ts, m)
    kept = k.scratch.put(graph.basin_keep_set(k.scratch, m, b, ab, CUTS, 1.0), "kept")
    name = F.concat_ws("|", F.col(NET), F.col("cut").cast("string"))
    cuts = F.explode(F.array(*[F.lit(float(c)) for c in CUTS]))
    each = lambda df: df.withColumn("cut", cuts).withColumn(NET, name).drop("cut")
    e = k.scratch.put(reduce.transform(k.scratch, each(micro), kept.select(name.alias(NET), "node")), "reduced")
    t = reduce.passage(k.scratch, e, each(ab)).select(NET, "mfpt_ab", "mfpt_ba")
    modes = reduce.spectrum(e, k=5).groupBy(NET).agg(*[F.max(F.when(F.col("mode") == i, F.col("t"))).alias(f"t_relax_{i}") for i in range(1, 6)])
    n = e.select(NET, "src").distinct().groupBy(NET).agg(F.count("*").alias("n_eff"))
    out = n.join(t, NET, "left").join(modes, NET, "left")
    at = F.split(F.col(NET), "\\|")
    return out.withColumns({"cut": F.element_at(at, -1).cast("double"), NET: at[0]})


def eigengap(spark, sf):
    """Steps between neighbouring slow modes of each reduced network, and the mode after the largest one."""
    return Ktn(spark, sf, "f18").each(single.eigengap, "largest_gap double, after_mode int, gaps long", _gaps)


def _gaps(k: Ktn) -> DataFrame:
    _, m = coarse_of(k)
    s = m.scratch.put(reduce.spectrum(m.moments), "modes")
    w = Window.partitionBy(NET).orderBy("mode")  # ten modes
    g = s.withColumn("gap", F.col("lambda") - F.lead("lambda").over(w)).filter("gap IS NOT NULL")
    return g.groupBy(NET).agg(F.max("gap").alias("largest_gap"), F.max_by("mode", "gap").alias("after_mode"), F.count("*").alias("gaps"))


QUERIES = {f.__name__: f for f in (
    distance_features, centrality_features, path_features_ab, spectral_communities, graph_features, graph_features_lite, node_tensor, edge_tensor, node_enrichment, branches_from_generator, generator_from_rates, dense_index,
    gt_stationary, ab_set_kinetics, micro_report_built, micro_report_core, robustness_grid, eigengap,
)}


def _ways(prefix: str, name: str) -> str:
    d = f"SELECT x.network_id, x.side, x.dist FROM {prefix}60 x JOIN ab ON ab.network_id = x.network_id AND ab.min_id = x.node AND ab.side <> x.side"
    return f"{name} AS (SELECT network_id, " + ", ".join(f"{f}(CASE WHEN side = '{s}' THEN dist END) AS {k}_{w}" for s, w in (("A", "ab"), ("B", "ba")) for f, k in (("MIN", "mn"), ("AVG", "me"))) + f" FROM ({d}) GROUP BY 1)"


_STEP = "SELECT network_id, side, node, MIN(dist) AS dist FROM (SELECT * FROM {{p}} UNION ALL SELECT d.network_id, d.side, e.dst, d.dist + e.len FROM {{p}} d JOIN {le} e ON e.network_id = d.network_id AND e.src = d.node) GROUP BY 1, 2, 3"


def _lengths(prefix: str, name: str, edges: str) -> list[str]:
    """Edge lengths, sixty Bellman-Ford rounds from A and B, and the lengths between them."""
    edges = edges.replace("le0", f"{prefix}le0").replace("le AS", f"{prefix}le AS")
    return [edges, *_chain_sql(prefix, "SELECT network_id, side, min_id AS node, 0.0::DOUBLE AS dist FROM ab", _STEP.format(le=f"{prefix}le"), 60), _ways(prefix, name)]


_BARRIER = "pb AS (SELECT network_id, LEAST(f, i) AS u, GREATEST(f, i) AS v, MIN(barrier) AS len FROM barriers GROUP BY 1, 2, 3), le AS MATERIALIZED (SELECT network_id, u AS src, v AS dst, len FROM pb WHERE len > 0 UNION ALL SELECT network_id, v, u, len FROM pb WHERE len > 0)"
_Z = lambda x, m="TRUE": f"CASE WHEN STDDEV_POP({x}) FILTER (WHERE {m}) OVER w > 0 AND {m} THEN ({x} - AVG({x}) FILTER (WHERE {m}) OVER w) / STDDEV_POP({x}) FILTER (WHERE {m}) OVER w ELSE 0.0 END"
_EDGE = f"""ed AS (SELECT x.network_id, x.src, x.dst, LN(GREATEST(x.k, 1e-300)) AS fwd, LN(GREATEST(y.k, 1e-300)) AS rev, x.b, CAST(y.k IS NOT NULL AS INT) AS has_reverse FROM branch x LEFT JOIN branch y ON y.network_id = x.network_id AND y.src = x.dst AND y.dst = x.src WHERE x.src <> x.dst),
ez AS MATERIALIZED (SELECT network_id, src, dst, {_Z('fwd')} AS z_fwd, {_Z('rev', 'has_reverse = 1')} AS z_rev, b, has_reverse FROM ed WINDOW w AS (PARTITION BY network_id))"""
_r5 = lambda *c: ", ".join(f"ROUND({x}, 5) AS {x}" for x in c)

SQL = {
    "distance_features": with_("branch", "barriers", "ab", more=",\n".join([*_lengths("b", "db", _len("b", "branch")), *_lengths("r", "dr", _len("k", "rates")), *_lengths("h", "dh", _BARRIER)]))
    + "SELECT a.network_id, " + ", ".join(f"ROUND({t}.{k}_{w}, 6) AS {n}_dist_{w}_{f}" for t, n in (("db", "branch"), ("dr", "rate")) for w in ("ab", "ba") for k, f in (("mn", "min"), ("me", "mean")))
    + ", ROUND(ABS(db.mn_ab - db.mn_ba), 6) AS branch_dist_asymmetry, ROUND(ABS(dr.mn_ab - dr.mn_ba), 6) AS rate_dist_asymmetry, ROUND(dh.mn_ab, 6) AS barrier_dist_ab_min, ROUND(dh.me_ab, 6) AS barrier_dist_ab_mean FROM (SELECT DISTINCT network_id FROM ab) a LEFT JOIN db USING (network_id) LEFT JOIN dr USING (network_id) LEFT JOIN dh USING (network_id)",
    "path_features_ab": with_("und", "rates", "ab", more=",\n".join(["ule AS (SELECT network_id, src, dst, 1.0::DOUBLE AS len FROM und)", *_chain_sql("u", "SELECT network_id, side, min_id AS node, 0.0::DOUBLE AS dist FROM ab", _STEP.format(le="ule"), 60), _ways("u", "du"), *_lengths("r", "dr", _len("k", "rates"))]))
    + "SELECT network_id, CAST(du.mn_ab AS BIGINT) AS shortest_path_hops_ab, ROUND(dr.mn_ab, 6) AS rate_shortest_path_ab, CAST(1 AS BIGINT) AS n_short_pairs_ab, 1.0::DOUBLE AS path_redundancy FROM du LEFT JOIN dr USING (network_id) WHERE du.mn_ab IS NOT NULL",
    "node_tensor": with_("pi", "wait", "ab", more=f"""x AS (SELECT p.network_id, p.node, LN(GREATEST(p.pi, 1e-300)) AS log_pi, LN(GREATEST(w.tau, 1e-300)) AS log_tau, m.energy, m.log_prod AS entropy FROM pi p JOIN wait w ON w.network_id = p.network_id AND w.node = p.node JOIN minima m ON m.network_id = p.network_id AND m.min_id = p.node),
s AS (SELECT network_id, AVG(LN(GREATEST(k, 1e-300))) AS mean_log_rate, STDDEV_POP(LN(GREATEST(k, 1e-300))) AS std_log_rate FROM rates WHERE src <> dst GROUP BY 1), l AS (SELECT network_id, AVG(log_tau) AS mean_log_tau FROM x GROUP BY 1),
z AS (SELECT network_id, node, {_Z('log_pi')} AS z_log_pi, {_Z('log_tau')} AS z_log_tau, {_Z('energy')} AS z_energy, {_Z('entropy')} AS z_entropy FROM x WINDOW w AS (PARTITION BY network_id))""")
    + f"SELECT network_id, node, {_r5('z_log_pi', 'z_log_tau', 'z_energy', 'z_entropy', 'mean_log_rate', 'std_log_rate', 'mean_log_tau')}, CAST(COALESCE(side = 'A', FALSE) AS INT) AS is_a, CAST(COALESCE(side = 'B', FALSE) AS INT) AS is_b FROM z LEFT JOIN s USING (network_id) LEFT JOIN l USING (network_id) LEFT JOIN (SELECT network_id, min_id AS node, side FROM ab) USING (network_id, node)",
    "edge_tensor": with_("branch", more=_EDGE) + f"SELECT network_id, src, dst, {_r5('z_fwd', 'z_rev', 'b')}, has_reverse FROM ez",
    "node_enrichment": with_("branch", "nodes", more=_EDGE + """,
o AS (SELECT network_id, src AS node, AVG(z_fwd) AS out_mean, MAX(z_fwd) AS out_max, SUM(b) AS b_out, COUNT(*) AS n_out FROM ez GROUP BY 1, 2), i AS (SELECT network_id, dst AS node, AVG(z_fwd) AS in_mean, MAX(z_fwd) AS in_max, COUNT(*) AS n_in FROM ez GROUP BY 1, 2),
e AS (SELECT network_id, node, COALESCE(out_mean, 0) AS out_mean, COALESCE(out_max, 0) AS out_max, COALESCE(in_mean, 0) AS in_mean, COALESCE(in_max, 0) AS in_max, COALESCE(b_out, 0) AS b_out, (COALESCE(n_out, 0) + COALESCE(n_in, 0)) / COUNT(*) OVER (PARTITION BY network_id) AS deg_frac FROM nodes LEFT JOIN o USING (network_id, node) LEFT JOIN i USING (network_id, node))""")
    + f"SELECT network_id, node, {_r5('out_mean', 'out_max', 'in_mean', 'in_max', 'b_out', 'deg_frac')} FROM e",
    "branches_from_generator": with_("branch") + "SELECT network_id, src, dst, ROUND(b, 8) AS b FROM branch WHERE src <> dst",
    "generator_from_rates": with_("q") + "SELECT network_id, src AS node, COUNT(*) AS entries, ROUND(MAX(CASE WHEN src = dst THEN q END), 6) AS diagonal, CAST(ABS(SUM(q)) < 1e-9 AS INT) AS sums_to_zero FROM q GROUP BY 1, 2",
    "dense_index": with_("cuts", more="""d AS (SELECT s.*, COALESCE(NOT s.must AND s.fe > c.fe_cut AND s.tau < c.tau_cut, FALSE) AS dropped FROM states s LEFT JOIN cuts c USING (network_id)),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id, dropped ORDER BY pi DESC, node) AS rn, COUNT(*) FILTER (WHERE NOT dropped) OVER (PARTITION BY network_id) AS n_kept FROM d),
k AS (SELECT network_id, node, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY node) - 1 AS place FROM n WHERE NOT dropped OR rn <= 10 - n_kept)""") + "SELECT network_id, node, side, place FROM k FULL JOIN (SELECT network_id, min_id AS node, side FROM ab) USING (network_id, node)",
    "micro_report_core": with_("q", "pi", "ab", more="""c AS (SELECT network_id, COUNT(*) AS n, SUM(k) AS nnz, SUM(dp) AS dp, SUM(op) AS op FROM (SELECT network_id, src, COUNT(*) AS k, COUNT(*) FILTER (WHERE src = dst AND q > 1e-12) AS dp, COUNT(*) FILTER (WHERE src <> dst AND q < -1e-12) AS op FROM q GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT network_id, SUM(b) AS b, SUM(ABS(a)) AS a FROM (SELECT q.network_id, q.dst, SUM(q.q * p.pi) AS a, SUM(ABS(q.q) * p.pi) AS b FROM q JOIN pi p ON p.network_id = q.network_id AND p.node = q.src GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT network_id, SUM(pi) AS pi_sum, MAX(pi) AS pi_max FROM pi GROUP BY 1), t AS (SELECT network_id, COUNT(*) FILTER (WHERE side = 'A') AS na, COUNT(*) FILTER (WHERE side = 'B') AS nb, MAX(CASE WHEN side = 'A' THEN min_id END) AS a_index, MAX(CASE WHEN side = 'B' THEN min_id END) AS b_index FROM ab GROUP BY 1)""")
    + "SELECT network_id, c.n, CAST(nnz AS BIGINT) AS nnz, ROUND(nnz / c.n, 6) AS nnz_per_state, ROUND(pi_sum, 9) AS pi_sum, ROUND(pi_max, 9) AS pi_max, CAST(dp AS BIGINT) AS diag_pos_count, CAST(op AS BIGINT) AS off_neg_count, ROUND(s.b, 6) AS absqpi_norm1, CAST(s.a / s.b < 1e-10 AS INT) AS stationary_ok, na, nb, CAST(0 AS BIGINT) AS ab_overlap, a_index, b_index, CASE WHEN dp = 0 AND op = 0 AND s.a / s.b < 1e-10 THEN 'OK' ELSE 'CHECK' END AS status FROM c JOIN s USING (network_id) JOIN p USING (network_id) LEFT JOIN t USING (network_id)",
}
