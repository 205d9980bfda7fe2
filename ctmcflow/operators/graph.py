"""Graph algorithms over edge lists of many networks at once: edges(network_id, src, dst[, weight]).

A network of at most ``TASK_EDGES`` edges goes through its loop in one task. For larger ones, loops keep one small state
table, join it to the edges and write each generation to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from ctmcflow.session import Scratch

NET = "network_id"
TASK_EDGES = 4_000_000  # edges of a network that one task takes
TASK_NODES = 2000  # nodes of a network whose adjacency one task takes as a matrix


def _large(edges: DataFrame, most: int) -> list:
    """The networks of more than ``most`` edges; there are few of them."""
    return [r[0] for r in edges.groupBy(NET).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(NET).collect()]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def by_network(df: DataFrame) -> GroupedData:
    """Groups of networks in enough tasks that few meet in one: small partitions would be put together, whatever a network's work."""
    return df.repartition(max(96, 4 * df.sparkSession.sparkContext.defaultParallelism), NET).groupBy(NET)


def _sums(names: np.ndarray, src, dst, w):
    """x -> the sums of w x[src] by dst, for nodes given by sorted names."""
    s, d = np.searchsorted(names, src), np.searchsorted(names, dst)
    order = np.argsort(d, kind="stable")
    s, d, w = s[order], d[order], np.asarray(w, float)[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, int)
    rows = d[first]

    def times(x: np.ndarray) -> np.ndarray:
        y = np.zeros(len(names))
        if len(rows):
            y[rows] = np.add.reduceat(w * x[s], first)
        return y

    return times


def symmetrise(edges: DataFrame) -> DataFrame:
    """Undirected, without self-loops: both directions of every edge once."""
    e = edges.filter("src <> dst")
    return e.select(NET, "src", "dst").union(e.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """``symmetrise`` with out and inn: 1 where an edge goes that way, or comes."""
    e = edges.filter("src <> dst")
    go = e.select(NET, "src", "dst", F.lit(1).alias("out"), F.lit(0).alias("inn"))
    come = e.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("out"), F.lit(1).alias("inn"))
    return go.union(come).groupBy(NET, "src", "dst").agg(F.max("out").alias("out"), F.max("inn").alias("inn"))


def roots(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same rounds for one network of n nodes: the least node of every node's component."""
    root = np.arange(n)
    while True:
        a, b = root[s], root[d]
        apart = a != b
        if not apart.any():
            return root
        s, d, a, b = s[apart], d[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _components_of(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """A network's rows of nodes with comp."""
    names = np.unique(nodes["node"])
    s, d = edges["src"].to_numpy(), edges["dst"].to_numpy()
    known = np.isin(s, names) & np.isin(d, names)
    root = roots(len(names), np.searchsorted(names, s[known]), np.searchsorted(names, d[known]))
    return nodes.assign(comp=names[root[np.searchsorted(names, nodes["node"])]])


def components(scratch: Scratch, nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, most: int = TASK_EDGES) -> DataFrame:
    """Component of every node: ``by`` columns (network_id), node, comp = its least node. Isolated nodes are their own.

    Every round takes the least label around a node, hooks larger labels to smaller ones and jumps pointers
    until they are final, so rounds grow with the logarithm of the longest path. Networks of at most ``most`` edges
    make their rounds in one task.
    """
    by = by or [NET]
    e = scratch.put(edges.filter("src <> dst").select(*by, "src", "dst").distinct(), "cc_edges")
    large = _large(e, most)
    nodes, known = nodes.select(*by, "node"), F.col("node").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    alone = nodes.filter(~known).withColumn("comp", F.col("node"))  # meets no edge
    near = lambda df: df.filter(~F.col(NET).isin(large)) if large else df
    kinds = ", ".join(f"{c} {_kind(nodes, c)}" for c in [*by, "node"]) + f", comp {_kind(nodes, 'node')}"
    pairs = near(nodes.filter(known)).groupBy(*by).cogroup(near(e).groupBy(*by))
    small = pairs.applyInPandas(_components_of, kinds)
    if not large:
        return small.unionByName(alone)
    nodes, e = (df.filter(F.col(NET).isin(large)) for df in (nodes.filter(known), e))
    return small.unionByName(alone).unionByName(_components_joined(scratch, nodes, e, by))


def _components_joined(scratch: Scratch, nodes: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
    labels = nodes.select(*by, "node", F.col("node").alias("comp"))
    while True:
        a = labels.select(*by, F.col("node").alias("src"), F.col("comp").alias("ca"))
        b = labels.select(*by, F.col("node").alias("dst"), F.col("comp").alias("cb"))
        pairs = e.join(a, [*by, "src"]).join(b, [*by, "dst"]).filter("ca <> cb")
        hooks = scratch.put(pairs.groupBy(*by, F.greatest("ca", "cb").alias("old")).agg(F.min(F.least("ca", "cb")).alias("new")), "cc_hooks", keep=2)
        if hooks.limit(1).count() == 0:
            return labels
        while True:
            # two jumps in one table: four times the way
            jumped = _jump(_jump(hooks.withColumn("moved", F.lit(False)), by), by)
            jumped = scratch.put(jumped, "cc_jump", keep=2)
            hooks = jumped.drop("moved")
            if jumped.filter("moved").limit(1).count() == 0:
                break
        labels = labels.join(hooks.withColumnRenamed("old", "comp"), [*by, "comp"], "left").select(*by, "node", F.coalesce("new", "comp").alias("comp"))
        labels = scratch.put(labels, "cc_labels", keep=2)


def _jump(hooks: DataFrame, by: list[str]) -> DataFrame:
    """Hooks (old, new, moved) followed once more; moved says whether any of the ways so far went on."""
    nxt = hooks.select(*by, F.col("old").alias("new"), F.col("new").alias("further"))
    return hooks.join(nxt, [*by, "new"], "left").select(*by, "old", F.coalesce("further", "new").alias("new"), (F.col("moved") | F.col("further").isNotNull()).alias("moved"))


def component_sizes(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or [NET]
    size = labels.groupBy(*by, "comp").agg(F.count("*").alias("n"))
    return size.groupBy(*by).agg(F.count("*").alias("n_components"), F.sum("n").alias("n_nodes"), F.max("n").alias("largest")).withColumn("largest_frac", F.col("largest") / F.col("n_nodes"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of each network's largest component (ties: the one with the least node)."""
    size = labels.groupBy(NET, "comp").agg(F.count("*").alias("n"))
    best = size.groupBy(NET).agg(F.max(F.struct("n", -F.col("comp"))).alias("b")).select(NET, (-F.col("b.col2")).alias("comp"))
    return labels.join(best, [NET, "comp"], "left_semi").select(NET, "node")


def basin_keep_set(scratch: Scratch, minima: DataFrame, barriers: DataFrame, ab: DataFrame, cuts: list[float], window: float | None = None) -> DataFrame:
    """Kept minima for every cut: the lowest of each low-barrier basin, A and B, the global minimum, and all within
    ``window`` of it. Result: network_id, cut, node."""
    grid = minima.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")
    low = barriers.join(F.broadcast(grid), F.col("barrier") <= F.col("cut")).select(NET, "cut", F.col("f").alias("src"), F.col("i").alias("dst"))
    nodes = minima.select(NET, F.col("min_id").alias("node"), "energy").crossJoin(F.broadcast(grid))  # a grid of a few cuts
    comp = components(scratch, nodes, low, [NET, "cut"])
    c = comp.join(minima.select(NET, F.col("min_id").alias("node"), "energy"), [NET, "node"])
    reps = c.groupBy(NET, "cut", "comp").agg(F.min(F.struct("energy", "node")).alias("m")).select(NET, "cut", F.col("m.node").alias("node"))
    lowest = minima.groupBy(NET).agg(F.min("energy").alias("e0"))
    extra = ab.select(NET, F.col("min_id").alias("node")).union(minima.join(lowest, NET).filter(F.col("energy") - F.col("e0") <= (window or 0.0)).select(NET, F.col("min_id").alias("node")))
    return reps.union(extra.crossJoin(F.broadcast(grid)).select(NET, "cut", "node")).distinct()


STEPS = 5  # steps of a loop in one written generation


def _settled(r: DataFrame, tol: float) -> bool:
    """Whether the last step moved less than tol in every network: the sum of absolute changes, as the reference takes it."""
    return r.groupBy(NET).agg(F.sum("change").alias("c")).filter(F.col("c") >= tol).limit(1).count() == 0


def _powers(e: DataFrame, r: DataFrame, value: str, times: int) -> DataFrame:
    """edges(network_id, src, dst, w) applied ``times`` times to r(network_id, node, value). A step reads the one before it once, so plans stay short."""
    for _ in range(times):
        r = e.join(r.select(NET, F.col("node").alias("src"), value), [NET, "src"]).groupBy(NET, F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return r


TELEPORT = -1  # the node that holds a network's total and hands it out again; states have numbers from 0


def _pagerank_of(steps: int, alpha: float, tol: float):
    """PageRank of one network from its nodes and its rates."""

    def run(nodes: pd.DataFrame, rates: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(nodes["node"])
        n = len(names)
        if n == 0:
            return pd.DataFrame({NET: [], "node": [], "r": []})
        src, k = np.searchsorted(names, rates["src"]), rates["k"].to_numpy(float)
        times = _sums(names, rates["src"], rates["dst"], alpha * k / np.bincount(src, k, n)[src] if len(k) else k)
        r = np.full(n, 1 / n)
        for done in range(1, steps + 1):
            was = r
            r = times(was) + (1 - alpha) / n
            r = r / r.sum()
            if done % STEPS == 0 and np.abs(r - was).sum() < tol:
                break
        return pd.DataFrame({NET: nodes[NET].iloc[0], "node": names, "r": r})

    return run


def pagerank(scratch: Scratch, nodes: DataFrame, rates: DataFrame, steps: int = 10, alpha: float = 0.85, tol: float | None = None, most: int = TASK_EDGES) -> DataFrame:
    """PageRank on column-normalised rates, renormalised after each step; nodes without out-edges send nothing.

    ``steps`` steps; with tol, at most so many, until a step changed less than tol in every network, which is looked at
    after every ``STEPS`` of them. The total of a network is one more node that every node with edges pays into, so a step
    is one linear map, several steps are one plan, and values are scaled when they are written. With tol, networks of at
    most ``most`` edges take one task each.
    """
    if tol is not None:
        large = _large(rates, most)
        near = lambda df: df.filter(~F.col(NET).isin(large)) if large else df
        pairs = by_network(near(nodes).select(NET, "node")).cogroup(by_network(near(rates).select(NET, "src", "dst", "k")))
        small = scratch.put(pairs.applyInPandas(_pagerank_of(steps, alpha, tol), f"{NET} string, node {_kind(nodes, 'node')}, r double"), "pr_small")
        if not large:
            return small
        far = [df.filter(F.col(NET).isin(large)) for df in (nodes, rates)]
        return small.unionByName(_pagerank_joined(scratch, *far, steps, alpha, tol))
    return _pagerank_joined(scratch, nodes, rates, steps, alpha, None)


def _pagerank_joined(scratch: Scratch, nodes: DataFrame, rates: DataFrame, steps: int, alpha: float, tol: float | None) -> DataFrame:
    out = rates.groupBy(NET, "src").agg(F.sum("k").alias("t"))
    size = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    hub = F.lit(TELEPORT).cast("long")
    parts = [
        rates.join(out, [NET, "src"]).select(NET, "src", "dst", (alpha * F.col("k") / F.col("t")).alias("w")),
        out.select(NET, "src", hub.alias("dst"), F.lit(alpha).alias("w")),
        nodes.join(size, NET).select(NET, hub.alias("src"), F.col("node").alias("dst"), ((1 - alpha) / F.col("n")).alias("w")),
        size.select(NET, hub.alias("src"), hub.alias("dst"), F.lit(1 - alpha).alias("w")),
    ]
    e = scratch.put(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "pr_edges")
    start = nodes.join(size, NET).select(NET, "node", (1.0 / F.col("n")).alias("r")).unionByName(size.select(NET, hub.alias("node"), F.lit(1.0).alias("r")))
    r = scratch.put(start, "pr", keep=2)
    total = lambda x: x.filter(F.col("node") == TELEPORT).select(NET, F.col("r").alias("t"))
    scaled = lambda x: x.join(total(x), NET).select(NET, "node", (F.col("r") / F.col("t")).alias("r"))
    done = 0
    while done < steps:
        n = min(STEPS, steps - done)
        done += n
        if tol is None:
            r = scratch.put(_powers(e, r, "r", n), "pr", keep=2)
            continue
        before = scratch.put(_powers(e, r, "r", n - 1), "pr_before", keep=2) if n > 1 else r
        r = scratch.put(scaled(scratch.put(_powers(e, before, "r", 1), "pr_raw", keep=2)), "pr", keep=2)
        change = r.join(scaled(before).withColumnRenamed("r", "was"), [NET, "node"]).select(NET, F.abs(F.col("r") - F.col("was")).alias("change"))
        if _settled(change, tol):
            break
    return scaled(r).filter(F.col("node") != TELEPORT)


def eigenvector_centrality(scratch: Scratch, nodes: DataFrame, edges: DataFrame, steps: int = 10, tol: float | None = None, most: int = TASK_EDGES, und: DataFrame | None = None) -> DataFrame:
    """The dominant eigenvector of the symmetric adjacency, positive and scaled to sum 1.

    Without tol: ``steps`` plain power steps with the adjacency plus the identity. With tol: each round makes the
    powers up to ``STEPS`` of the vector by joins and takes the best combination of them, from their products per network
    (Rayleigh and Ritz), until a power step would change less than tol in every network; an error after ``steps`` rounds.
    Networks of at most ``most`` edges make their rounds in one task each. Every network should be connected.
    """
    loops = nodes.select(NET, F.col("node").alias("src"), F.col("node").alias("dst"))
    both = symmetrise(edges) if und is None else und.select(NET, "src", "dst")
    e = both.unionByName(loops).withColumn("w", F.lit(1.0))
    e = scratch.put(e, "ev_edges") if und is None else e
    size = nodes.groupBy(NET).agg(F.count("*").alias("n"))
    r = nodes.select(NET, "node").join(size, NET).select(NET, "node", (1.0 / F.col("n")).alias("r"))
    done = 0
    while tol is None and done < steps:
        n = min(STEPS, steps - done)
        done += n
        x = scratch.put(_powers(e, r, "r", n), "ev", keep=2)
        r = x.join(x.groupBy(NET).agg(F.sum("r").alias("s")), NET).select(NET, "node", (F.col("r") / F.col("s")).alias("r"))
    if tol is None:
        return r
    large, kind = _large(e, most), f"{NET} string, node {_kind(nodes, 'node')}, r double, change double"
    near = e.filter(~F.col(NET).isin(large)) if large else e
    small = scratch.put(by_network(near.select(NET, "src", "dst")).applyInPandas(_dominant(steps, tol), kind), "ev_small")
    if not _settled(small, tol):
        raise ValueError(f"eigenvector centrality has not settled to {tol} in {steps} rounds")
    small = small.select(NET, "node", "r")
    if not large:
        return small
    e, r = (df.filter(F.col(NET).isin(large)) for df in (e, r))
    for _ in range(steps):
        powers = [scratch.put(r.select(NET, "node", F.col("r").alias("p0")), "ev_0", keep=2)]
        for i in range(1, STEPS + 1):
            was = powers[-1].select(NET, "node", F.col(f"p{i - 1}").alias(f"p{i}"))
            powers.append(scratch.put(_powers(e, was, f"p{i}", 1), f"ev_{i}", keep=2))
        t = powers[0]
        for p in powers[1:]:
            t = t.join(p, [NET, "node"])
        t = scratch.put(t, "ev_powers", keep=2)
        sums = [F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(STEPS + 1) for j in range(i, STEPS + 1)]
        best = t.groupBy(NET).agg(*sums).mapInPandas(_ritz, f"{NET} string, " + ", ".join(f"c{i} double" for i in range(STEPS)))
        mix = lambda k: sum((F.col(f"c{i}") * F.col(f"p{i + k}") for i in range(STEPS)), F.lit(0.0))
        x = scratch.put(t.join(best, NET).select(NET, "node", F.abs(mix(0)).alias("x"), F.abs(mix(1)).alias("y")), "ev_mixed", keep=2)
        total = x.groupBy(NET).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        new = F.col("y") / F.col("sy")
        r = scratch.put(x.join(total, NET).select(NET, "node", new.alias("r"), F.abs(new - F.col("x") / F.col("sx")).alias("change")), "ev", keep=2)
        if _settled(r, tol):
            return small.unionByName(r.select(NET, "node", "r"))
    raise ValueError(f"eigenvector centrality has not settled to {tol} in {steps} rounds")


def _dominant(steps: int, tol: float):
    """The same rounds for one network whose edges have the identity in them: network_id, node, r and the change of its last power step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["src"])
        times = _sums(names, pdf["src"], pdf["dst"], np.ones(len(pdf)))
        r, change = np.full(len(names), 1 / len(names)), np.zeros(len(names))
        for _ in range(steps):
            basis, x = [], r
            for _ in range(STEPS):
                for b in basis * 2:  # twice, as rounding leaves some of it
                    x = x - b * (b @ x)
                size = np.linalg.norm(x)
                if basis and size <= 1e-13 * scale:
                    break
                basis.append(x / size)
                x = times(basis[-1])
                scale = np.linalg.norm(x)
            q = np.array(basis).T
            m = q.T @ np.array([times(b) for b in basis]).T
            x = np.abs(q @ np.linalg.eigh((m + m.T) / 2)[1][:, -1])
            y = times(x)
            r = y / y.sum()
            change = np.abs(r - x / x.sum())
            if change.sum() < tol:
                break
        return pd.DataFrame({NET: pdf[NET].iloc[0], "node": names, "r": r, "change": change})

    return run


def _ritz(batches):
    """The combination of the first ``STEPS`` powers that has the largest Rayleigh quotient, per network, from the powers' products."""
    for pdf in batches:
        rows = []
        for _, r in pdf.iterrows():
            g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(STEPS + 1)] for i in range(STEPS + 1)], float)
            d = 1 / np.sqrt(np.diag(g))[:STEPS]  # powers grow: each to length one
            a, b = g[:STEPS, :STEPS] * np.outer(d, d), g[:STEPS, 1:] * np.outer(d, d)
            w, v = np.linalg.eigh((a + a.T) / 2)
            keep = w > 1e-13 * w[-1]
            z = v[:, keep] / np.sqrt(w[keep])
            m = z.T @ b @ z
            rows.append((r[NET], *(d * (z @ np.linalg.eigh((m + m.T) / 2)[1][:, -1]))))
        yield pd.DataFrame(rows, columns=[NET, *[f"c{i}" for i in range(STEPS)]])


def _shortest_of(edges: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Distances in one network, all edges relaxed until nothing falls."""
    names = np.unique(np.r_[edges["src"], edges["dst"], sources["node"]]) if len(edges) else np.unique(sources["node"])
    s, d, w = np.searchsorted(names, edges["src"]), np.searchsorted(names, edges["dst"]), edges["w"].to_numpy(float)
    known = ~np.isnan(w)  # an edge without a length is none
    s, d, w = s[known], d[known], w[known]
    order = np.argsort(d, kind="stable")
    s, d, w = s[order], d[order], w[order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, int)
    rows, out = d[first], []
    for side, nodes in sources.groupby("side")["node"]:
        dist = np.full(len(names), np.inf)
        dist[np.searchsorted(names, nodes)] = 0.0
        while len(rows):
            new = np.minimum.reduceat(dist[s] + w, first)
            if not (new < dist[rows]).any():
                break
            dist[rows] = np.minimum(dist[rows], new)
        met = np.isfinite(dist)
        out.append(pd.DataFrame({NET: sources[NET].iloc[0], "side": side, "node": names[met], "dist": dist[met]}))
    return pd.concat(out) if out else pd.DataFrame({NET: [], "side": [], "node": [], "dist": []})


def shortest(scratch: Scratch, edges: DataFrame, sources: DataFrame, weight: str | None = None, most: int = TASK_EDGES) -> DataFrame:
    """Distance from labelled source sets: sources(network_id, side, node) -> network_id, side, node, dist.

    Networks of at most ``most`` edges take one task each. In others only nodes whose distance fell in the last round are relaxed again, over up to three edges in one round; without a
    weight the distance is hops. Lengths must not be negative. Nodes out of reach do not come out.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select(NET, "src", "dst", w.alias("w"))
    sources, large = sources.select(NET, "side", "node"), _large(edges, most)
    near = lambda df: df.filter(~F.col(NET).isin(large)) if large else df
    pairs = by_network(near(e)).cogroup(by_network(near(sources)))
    small = scratch.put(pairs.applyInPandas(_shortest_of, f"{NET} string, side string, node {_kind(sources, 'node')}, dist double"), "sp_small")
    if not large:
        return small
    e, sources = (df.filter(F.col(NET).isin(large)) for df in (e, sources))
    e = scratch.put(e.groupBy(NET, "src", "dst").agg(F.min("w").alias("w")), "sp_edges")
    dist = scratch.put(sources.select(NET, "side", "node", F.lit(0.0).alias("dist")).distinct(), "sp", keep=2)
    front, key = dist, [NET, "side", "node"]
    while front.limit(1).count():
        step, ways = front, None
        for _ in range(3):
            step = step.select(NET, "side", F.col("node").alias("src"), "dist").join(e, [NET, "src"]).groupBy(NET, "side", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
            ways = step if ways is None else ways.unionByName(step)
        new = ways.groupBy(*key).agg(F.min("dist").alias("new"))
        both = dist.join(new, key, "full")
        better = F.coalesce(F.col("new") < F.col("dist"), F.col("dist").isNull())
        both = scratch.put(both.select(*key, F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")), "sp_next", keep=2)
        dist, front = both.drop("moved"), both.filter("moved").drop("moved")
    return small.unionByName(dist)


def closeness(hops: DataFrame) -> DataFrame:
    """Nodes reached over the sum of hops, per network and side."""
    return hops.groupBy(NET, "side").agg(F.count_if(F.col("dist") > 0).alias("reached"), F.sum("dist").alias("hops")).withColumn("closeness", F.try_divide("reached", "hops"))


def log_lengths(edges: DataFrame, value: str) -> DataFrame:
    """Lengths -ln(value), shifted per network so that the least is not negative."""
    e = edges.select(NET, "src", "dst", (-F.ln(F.greatest(F.col(value), F.lit(1e-300)))).alias("len"))
    low = e.groupBy(NET).agg(F.least(F.lit(0.0), F.min("len")).alias("low"))
    return e.join(low, NET).select(NET, "src", "dst", (F.col("len") - F.col("low")).alias("len"))


def degrees(nodes: DataFrame, edges: DataFrame, und: DataFrame | None = None) -> DataFrame:
    """in, out and undirected degree of every node, zeros kept. und: ``both_ways`` of the edges, where it is there already."""
    u = both_ways(edges) if und is None else und
    u = u.groupBy(NET, F.col("src").alias("node")).agg(F.sum("out").alias("deg_out"), F.sum("inn").alias("deg_in"), F.count("*").alias("deg"))
    return nodes.select(NET, "node").join(u, [NET, "node"], "left").fillna(0, ["deg_out", "deg_in", "deg"])


def topology(nodes: DataFrame, edges: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """Per network: nodes, edges, density and degree statistics. d: ``degrees``, where they are there already."""
    d = degrees(nodes, edges) if d is None else d
    g = d.groupBy(NET).agg(
        F.count("*").alias("n"), F.sum("deg_out").alias("edges_dir"), (F.sum("deg") / 2).cast("long").alias("edges_und"),
        F.avg("deg").alias("deg_mean"), F.min("deg").alias("deg_min"), F.max("deg").alias("deg_max"), F.stddev_pop("deg").alias("deg_std"), F.skewness("deg").alias("deg_skew"),
    )
    # degrees are small numbers: their counts are few rows
    per = d.groupBy(NET, "deg").agg(F.count("*").alias("c"))
    median = per.groupBy(NET).agg(F.expr("percentile(deg, 0.5, c)").alias("deg_median"))
    return g.join(median, NET).withColumn("density", F.try_divide(2.0 * F.col("edges_und"), F.col("n") * (F.col("n") - 1)))


def assortativity(nodes: DataFrame, edges: DataFrame, d: DataFrame | None = None, und: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of end degrees over undirected edges; 0 where it is undefined."""
    d = (degrees(nodes, edges) if d is None else d).select(NET, "node", F.col("deg").cast("double").alias("deg"))
    e = (symmetrise(edges) if und is None else und.select(NET, "src", "dst")).join(d.select(NET, F.col("node").alias("src"), F.col("deg").alias("a")), [NET, "src"]).join(d.select(NET, F.col("node").alias("dst"), F.col("deg").alias("b")), [NET, "dst"])
    c = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return e.groupBy(NET).agg(F.coalesce(c, F.lit(0.0)).alias("assortativity"))


def _triangles_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Triangles at each node of one network with all its edges both ways."""
    names, inv = np.unique(np.r_[pdf["src"], pdf["dst"]], return_inverse=True)
    a = np.zeros((len(names), len(names)), "float32")  # whole numbers below 2^24 are exact
    a[inv[: len(pdf)], inv[len(pdf) :]] = 1
    return pd.DataFrame({NET: pdf[NET].iloc[0], "node": names, "triangles": ((a @ a) * a).sum(1, dtype=float).astype("int64") // 2})


def triangles(nodes: DataFrame, edges: DataFrame, most: int = TASK_NODES, d: DataFrame | None = None, und: DataFrame | None = None) -> DataFrame:
    """Triangles and local clustering coefficient of every node. Edges point from the lower to the higher degree, so
    a hub's wedges are counted from its small neighbours and no node opens more than about sqrt(2 edges) of them.
    Networks of at most ``most`` nodes with an edge for 64 pairs or more are a matrix in one task."""
    d = degrees(nodes, edges) if d is None else d
    e = symmetrise(edges) if und is None else und.select(NET, "src", "dst")
    size = e.groupBy(NET).agg(F.count("*").alias("m"), F.count_distinct("src").alias("n"))
    thick = size.filter((F.col("n") <= most) & (64 * F.col("m") >= F.col("n") * F.col("n"))).select(NET)
    matrix = by_network(e.join(thick, NET, "left_semi")).applyInPandas(_triangles_of, f"{NET} string, node {_kind(nodes, 'node')}, triangles long")
    e = e.join(thick, NET, "left_anti")
    da, db = d.select(NET, F.col("node").alias("src"), F.col("deg").alias("da")), d.select(NET, F.col("node").alias("dst"), F.col("deg").alias("db"))
    o = e.join(da, [NET, "src"]).join(db, [NET, "dst"]).filter("da < db OR (da = db AND src < dst)").select(NET, "src", "dst")
    x = o.select(NET, F.col("src").alias("a"), F.col("dst").alias("b"))
    y = o.select(NET, F.col("src").alias("a"), F.col("dst").alias("c"))
    z = o.select(NET, F.col("src").alias("b"), F.col("dst").alias("c"))
    t = x.join(y, [NET, "a"]).join(z, [NET, "b", "c"])
    per = t.select(NET, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(NET, "node").agg(F.count("*").alias("triangles")).unionByName(matrix)
    r = d.join(per, [NET, "node"], "left").fillna(0, ["triangles"])
    return r.select(NET, "node", "triangles", F.when(F.col("deg") > 1, 2.0 * F.col("triangles") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("clustering"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman modularity of labels(network_id, node, comp), size entropy and largest share of the communities."""
    e = symmetrise(edges)
    a = labels.select(NET, F.col("node").alias("src"), F.col("comp").alias("ca"))
    b = labels.select(NET, F.col("node").alias("dst"), F.col("comp").alias("cb"))
    j = e.join(a, [NET, "src"]).join(b, [NET, "dst"])
    per = j.groupBy(NET, "ca").agg(F.sum((F.col("ca") == F.col("cb")).cast("double")).alias("inside"), F.count("*").cast("double").alias("deg"))
    total = e.groupBy(NET).agg(F.count("*").cast("double").alias("m2"))
    q = per.join(total, NET).groupBy(NET).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("deg") / F.col("m2")) * (F.col("deg") / F.col("m2"))).alias("modularity"))
    size = labels.groupBy(NET, "comp").agg(F.count("*").alias("n"))
    all_ = labels.groupBy(NET).agg(F.count("*").alias("t"))
    p = F.col("n") / F.col("t")
    s = size.join(all_, NET).groupBy(NET).agg(F.count("*").alias("n_communities"), (-F.sum(p * F.ln(p + 1e-300))).alias("size_entropy"), F.max(p).alias("largest_frac"))
    return s.join(q, NET, "left")


def standardise(df: DataFrame, columns: dict[str, Column | None], by: list[str]) -> DataFrame:
    """Adds z_<column>: (x - mean) / population deviation within ``by``, 0 where it does not vary. A column's mask
    says which rows count; the others get 0. Means come from one aggregate, so a large group is never gathered."""
    x = {c: F.col(c) if m is None else F.when(m, F.col(c)) for c, m in columns.items()}
    g = df.groupBy(*by).agg(*[F.avg(v).alias(f"_m_{c}") for c, v in x.items()], *[F.stddev_pop(v).alias(f"_s_{c}") for c, v in x.items()])
    j = df.join(g, by)
    out = {f"z_{c}": F.when((F.col(f"_s_{c}") > 0) & v.isNotNull(), (v - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c, v in x.items()}
    return j.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def sparsify(edges: DataFrame, score: str, k: int = 20) -> DataFrame:
    """The k best out-edges of every source plus the reverse of each kept edge where it exists; k <= 0 keeps all."""
    if k <= 0:
        return edges
    w = Window.partitionBy(NET, "src").orderBy(F.col(score).desc_nulls_last(), "dst")
    top = edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
    back = top.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return top.unionByName(edges.join(back, [NET, "src", "dst"], "left_semi").join(top.select(NET, "src", "dst"), [NET, "src", "dst"], "left_anti"))
