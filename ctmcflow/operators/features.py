"""The feature groups of a kinetic network, each a frame with one row per network, and the wide row of all of them.

A ``Model`` holds the relations of many networks, microscopic or reduced. Sources of paths are the single states of A and B,
so that means over pairs of states are those of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ctmcflow.functions import sequence as seq
from ctmcflow.operators import community, ctmc, graph, reduce
from ctmcflow.operators.graph import NET
from ctmcflow.session import Scratch

ALL = ("sequence", "distance", "spectral", "centrality", "community", "path", "topology")
LITE = ("sequence", "distance", "spectral", "centrality", "topology")


@dataclass
class Model:
    scratch: Scratch
    nodes: DataFrame  # network_id, node
    rates: DataFrame  # network_id, src, dst, k
    branches: DataFrame  # network_id, src, dst, b
    pi: DataFrame  # network_id, node, pi
    ab: DataFrame  # network_id, min_id, side
    moments: DataFrame  # network_id, src, dst, p, a, c: edges as in ``reduce``
    barriers: DataFrame | None = None  # network_id, u, v, barrier: the least barrier of each pair

    @cached_property
    def und(self) -> DataFrame:
        """``graph.both_ways`` of the rates, written once."""
        return self.scratch.put(graph.both_ways(self.rates), "und")


def reduced_model(scratch: Scratch, edges: DataFrame, pi: DataFrame, ab: DataFrame) -> Model:
    """The model of transformed edges: rates p / tau with the mean time tau of a jump, and their stationary distribution."""
    tau = edges.groupBy(NET, "src").agg(F.sum("a").alias("tau"))
    e = scratch.put(edges.filter("src <> dst").join(tau, [NET, "src"]).select(NET, "src", "dst", "p", (F.col("p") / F.col("tau")).alias("k")), "model")
    nodes = tau.select(NET, F.col("src").alias("node"))
    return Model(scratch, nodes, e.select(NET, "src", "dst", "k"), e.select(NET, "src", "dst", F.col("p").alias("b")), pi, ab, edges)


def pair_distances(m: Model, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Least lengths between the states of A and those of B, both ways: network_id, start (side), source, node, dist."""
    sources = m.ab.select(NET, F.concat_ws(":", "side", "min_id").alias("side"), F.col("min_id").alias("node"))
    d = graph.shortest(m.scratch, edges, sources, weight)
    to = m.ab.select(NET, F.col("side").alias("goal"), F.col("min_id").alias("node"))
    d = d.join(to, [NET, "node"]).select(NET, F.substring("side", 1, 1).alias("start"), F.split_part("side", F.lit(":"), F.lit(2)).cast("long").alias("source"), "goal", "node", "dist")
    return d.filter("start <> goal").drop("goal")


def distance(m: Model) -> DataFrame:
    """12 columns: least and mean lengths from A to B and back by branching and by rate, their asymmetry, and by barrier."""
    kinds = {"branch": (graph.log_lengths(m.branches, "b"), "len"), "rate": (graph.log_lengths(m.rates, "k"), "len")}
    if m.barriers is not None:
        b = m.barriers.filter("barrier > 0")  # a length of 0 is no edge there
        kinds["barrier"] = (b.select(NET, F.col("u").alias("src"), F.col("v").alias("dst"), "barrier").union(b.select(NET, F.col("v").alias("src"), F.col("u").alias("dst"), "barrier")), "barrier")
    out = m.ab.select(NET).distinct()
    for name, (edges, weight) in kinds.items():
        one = lambda s, f: f(F.when(F.col("start") == s, F.col("dist")))
        cols = {f"{name}_dist_{way}_{k}": one(s, f) for way, s in (("ab", "A"), ("ba", "B")) for k, f in (("min", F.min), ("mean", F.avg)) if name != "barrier" or s == "A"}
        d = pair_distances(m, edges, weight).groupBy(NET).agg(*[c.alias(k) for k, c in cols.items()])
        if name != "barrier":
            d = d.withColumn(f"{name}_dist_asymmetry", F.abs(F.col(f"{name}_dist_ab_min") - F.col(f"{name}_dist_ba_min")))
        out = out.join(m.scratch.put(d, f"dist_{name}"), NET, "left")
    if m.barriers is None:
        out = out.withColumns({f"barrier_dist_ab_{k}": F.lit(None).cast("double") for k in ("min", "mean")})
    return out


def by_side(values: DataFrame, ab: DataFrame, column: str, name: str) -> DataFrame:
    """Sums of a node column over A and over B."""
    j = values.join(ab.select(NET, F.col("min_id").alias("node"), "side"), [NET, "node"])
    return j.groupBy(NET).agg(*[F.sum(F.when(F.col("side") == s, F.col(column))).alias(f"{name}_{s.lower()}") for s in "AB"])


def centrality(m: Model) -> DataFrame:
    """9 columns: sums over A and over B of pi, PageRank, eigenvector centrality and closeness, and the ratio of the pi sums."""
    pi = by_side(m.pi, m.ab, "pi", "pi").withColumn("pi_ratio_ab", F.col("pi_a") / F.greatest(F.coalesce("pi_b", F.lit(0.0)), F.lit(1e-300)))
    pr = by_side(graph.pagerank(m.scratch, m.nodes, m.rates, 200, tol=1e-8), m.ab, "r", "pagerank")
    ev = by_side(graph.eigenvector_centrality(m.scratch, m.nodes, m.rates, 1000, 1e-10, und=m.und), m.ab, "r", "eigvec_centrality")
    sources = m.ab.select(NET, F.concat_ws(":", "side", "min_id").alias("side"), F.col("min_id").alias("node"))
    c = graph.closeness(graph.shortest(m.scratch, m.und, sources))
    cl = c.groupBy(NET).agg(*[F.sum(F.when(F.col("side").startswith(s), F.coalesce("closeness", F.lit(0.0)))).alias(f"closeness_centrality_{s.lower()}") for s in "AB"])
    return pi.join(pr, NET, "left").join(ev, NET, "left").join(cl, NET, "left")


def communities(m: Model) -> DataFrame:
    """5 columns: number, modularity, whether A and B share one, size entropy and largest share of the spectral communities."""
    lab = m.scratch.put(community.communities(m.rates), "communities")
    q = community.weighted_modularity(m.rates, lab)
    size = lab.groupBy(NET, "comp").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("t")
    s = size.join(size.groupBy(NET).agg(F.sum("n").alias("t")), NET).groupBy(NET).agg(F.count("*").alias("n_communities"), (-F.sum(p * F.ln(p))).alias("community_size_entropy"), F.max(p).alias("largest_community_frac"))
    side = lab.join(m.ab.select(NET, F.col("min_id").alias("node"), "side"), [NET, "node"])
    same = side.groupBy(NET, "comp").agg(F.count_distinct("side").alias("k")).groupBy(NET).agg((F.max("k") == 2).cast("int").alias("ab_same_community"))
    return s.join(q, NET, "left").join(same, NET, "left")


def path(m: Model) -> DataFrame:
    """4 columns: fewest hops from A to B, least rate length between their first states, pairs within twice the hops, their share."""
    hops = m.scratch.put(pair_distances(m, m.und).filter("start = 'A'"), "hops")
    least = hops.groupBy(NET).agg(F.min("dist").alias("shortest_path_hops_ab"))
    n = hops.join(least, NET).groupBy(NET, "shortest_path_hops_ab").agg(F.count_if(F.col("dist") <= 2 * F.col("shortest_path_hops_ab")).alias("n_short_pairs_ab"))
    first = m.ab.groupBy(NET).agg(F.min(F.when(F.col("side") == "A", F.col("min_id"))).alias("a"), F.min(F.when(F.col("side") == "B", F.col("min_id"))).alias("b"), (F.count_if(F.col("side") == "A") * F.count_if(F.col("side") == "B")).alias("pairs"))
    start = first.select(NET, F.lit("A").alias("side"), F.col("a").alias("node"))
    d = graph.shortest(m.scratch, graph.log_lengths(m.rates, "k"), start, "len").join(first.select(NET, F.col("b").alias("node")), [NET, "node"]).select(NET, F.col("dist").alias("rate_shortest_path_ab"))
    return n.join(first, NET).join(d, NET, "left").select(NET, "shortest_path_hops_ab", "rate_shortest_path_ab", "n_short_pairs_ab", (F.col("n_short_pairs_ab") / F.greatest(F.col("pairs"), F.lit(1))).alias("path_redundancy"))


def topology(m: Model) -> DataFrame:
    """14 columns: sizes, density, degrees, assortativity, components and clustering."""
    d = m.scratch.put(graph.degrees(m.nodes, m.rates, m.und), "degrees")
    t = graph.topology(m.nodes, m.rates, d).select(NET, F.col("n").alias("n_nodes"), F.col("edges_dir").alias("n_edges_directed"), F.col("edges_und").alias("n_edges_undirected"), "density", F.col("deg_mean").alias("degree_mean"), F.col("deg_std").alias("degree_std"),
        F.col("deg_max").alias("degree_max"), F.col("deg_min").alias("degree_min"), F.coalesce(F.nanvl("deg_skew", F.lit(0.0)), F.lit(0.0)).alias("degree_skew"))
    a = graph.assortativity(m.nodes, m.rates, d, m.und).withColumnRenamed("assortativity", "degree_assortativity")
    c = graph.component_sizes(graph.components(m.scratch, m.nodes, m.rates.select(NET, "src", "dst"))).select(NET, "n_components", F.col("largest_frac").alias("largest_component_frac"))
    g = graph.triangles(m.nodes, m.rates, d=d, und=m.und).groupBy(NET).agg(F.avg("clustering").alias("clustering_coeff_mean"), F.stddev_pop("clustering").alias("clustering_coeff_std"))
    return t.join(a, NET, "left").join(c, NET, "left").join(g, NET, "left").fillna(0.0, ["degree_assortativity"])


def spectral(m: Model) -> DataFrame:
    """7 columns of the slow modes."""
    s = reduce.spectral_features(m.scratch.put(reduce.spectrum(m.moments), "modes"), m.moments)
    return s.select(NET, *[F.col(c).alias(f"spectral_{c}") for c in s.columns if c != NET])


def sequence(m: Model, name: Column | None = None) -> DataFrame:
    """14 columns of the peptide sequence, which is the part of the network's name before its variant unless given."""
    n = m.ab.select(NET).distinct()
    return n.select(NET, *[c.alias(k) for k, c in seq.composition(F.split_part(F.col(NET), F.lit("_"), F.lit(1)) if name is None else name).items()])


GROUPS = {"sequence": sequence, "distance": distance, "spectral": spectral, "centrality": centrality, "community": communities, "path": path, "topology": topology}


def feature_row(m: Model, groups: tuple[str, ...] = ALL) -> DataFrame:
    """One wide row per network of m.nodes, with status.

    MISSING_AB: neither A nor B is known; EMPTY_AB: one of them has no state; PARTIAL(...): a group names nothing
    for the network (its columns are null); else OK.
    """
    sides = m.ab.groupBy(NET).agg(F.count_distinct("side").alias("_sides"))
    out = m.nodes.select(NET).distinct().join(sides, NET, "left")
    gaps = []
    for g in groups:
        f = GROUPS[g](m)
        cols = [c for c in f.columns if c != NET]
        out = out.join(m.scratch.put(f, f"group_{g}"), NET, "left")
        gaps.append(F.when(F.coalesce(*[F.col(c).cast("double") for c in cols]).isNull(), F.lit(g)))
    lost = F.concat_ws("; ", *gaps)
    status = F.when(F.col("_sides").isNull(), "MISSING_AB").when(F.col("_sides") < 2, "EMPTY_AB").when(lost != "", F.concat(F.lit("PARTIAL("), lost, F.lit(")"))).otherwise("OK")
    return out.withColumn("status", status).drop("_sides")


# --- node and edge tensors ----------------------------------------------------------------------
def node_tensor(minima: DataFrame, rates: DataFrame, ab: DataFrame) -> DataFrame:
    """Nine values of every state with a way out: standardised log pi, log tau, energy and entropy within the network, A, B, and the network's mean and deviation of log rates and mean log tau."""
    w = ctmc.waiting_times(rates).select(NET, "node", F.ln(F.greatest("tau", F.lit(1e-300))).alias("log_tau"))
    x = ctmc.equilibrium(minima).select(NET, "node", F.ln(F.greatest("pi", F.lit(1e-300))).alias("log_pi"))
    x = x.join(w, [NET, "node"]).join(minima.select(NET, F.col("min_id").alias("node"), "energy", F.col("log_prod").alias("entropy")), [NET, "node"])
    z = graph.standardise(x, dict.fromkeys(("log_pi", "log_tau", "energy", "entropy")), [NET])
    side = ab.groupBy(NET, F.col("min_id").alias("node")).agg(*[F.max((F.col("side") == s).cast("int")).alias(f"is_{s.lower()}") for s in "AB"])
    k = F.ln(F.greatest("k", F.lit(1e-300)))
    scale = rates.filter("src <> dst").groupBy(NET).agg(F.avg(k).alias("mean_log_rate"), F.stddev_pop(k).alias("std_log_rate"))
    scale = scale.join(x.groupBy(NET).agg(F.avg("log_tau").alias("mean_log_tau")), NET, "full")
    return z.join(side, [NET, "node"], "left").join(scale, NET, "left").fillna(0, ["is_a", "is_b"]).select(NET, "node", "z_log_pi", "z_log_tau", "z_energy", "z_entropy", "is_a", "is_b", "mean_log_rate", "std_log_rate", "mean_log_tau")


def edge_tensor(rates: DataFrame) -> DataFrame:
    """Four values of every edge: standardised log rate, standardised log rate of the way back (0 without one), branching probability, whether there is a way back."""
    b = ctmc.branching(rates).filter("src <> dst").select(NET, "src", "dst", F.ln(F.greatest("k", F.lit(1e-300))).alias("fwd"), "b")
    back = b.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("fwd").alias("rev"))
    j = b.join(back, [NET, "src", "dst"], "left").withColumn("has_reverse", F.col("rev").isNotNull().cast("int"))
    return graph.standardise(j, {"fwd": None, "rev": F.col("has_reverse") == 1}, [NET]).select(NET, "src", "dst", "z_fwd", "z_rev", "b", "has_reverse")


def node_enrichment(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Six values of every node from edges(z_fwd, b): mean and greatest rate out and in, branching out, edges over the network's nodes."""
    o = edges.groupBy(NET, F.col("src").alias("node")).agg(F.avg("z_fwd").alias("out_mean"), F.max("z_fwd").alias("out_max"), F.sum("b").alias("b_out"), F.count("*").alias("n_out"))
    i = edges.groupBy(NET, F.col("dst").alias("node")).agg(F.avg("z_fwd").alias("in_mean"), F.max("z_fwd").alias("in_max"), F.count("*").alias("n_in"))
    n = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    j = nodes.select(NET, "node").join(o, [NET, "node"], "left").join(i, [NET, "node"], "left").join(n, NET)
    j = j.fillna(0, ["n_out", "n_in"]).fillna(0.0, ["out_mean", "out_max", "in_mean", "in_max", "b_out"])
    return j.select(NET, "node", "out_mean", "out_max", "in_mean", "in_max", "b_out", ((F.col("n_out") + F.col("n_in")) / F.col("n")).alias("deg_frac"))
