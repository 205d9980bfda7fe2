"""Graph transformation: removing states while mean and variance of all passage times between kept ones stay.

An edge src -> dst carries the moments (p, a, c) of the time of the jump: probability, p times the mean
and p times the second moment. Removing x replaces every path j -> x -> ... -> x -> i; moments of
sequences multiply, and the loops of x add up to 1 / (1 - loop), where 1 - loop is taken as the sum of
the other branches, so nothing cancels.

A network of at most ``LOCAL`` removable states is done in one task: states of few neighbours one by one, the rest as
a matrix in blocks. Larger ones lose states in rounds before that: in each one those of least degree among their
removable neighbours, which are never adjacent, so one join is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ctmcflow.operators.graph import NET, by_network
from ctmcflow.session import Scratch

DENSE = 800
LOCAL, LOCAL_EDGES = 6000, 500_000  # removable states of a network, and edges at them, that one task takes
CORE = 3000  # states of the matrix of ``sparse_solver``
SPARSE, BLOCK = 20, 32  # neighbours up to which a state is removed by itself; states of a block of the matrix
EDGES = "network_id string, src long, dst long, p double, a double, c double"


def jump_moments(branches: DataFrame, tau: DataFrame) -> DataFrame:
    """Edges with moments of exponential waiting times: branches(network_id, src, dst, b), tau(network_id, node, tau)."""
    j = branches.join(tau.select(NET, F.col("node").alias("src"), "tau"), [NET, "src"])
    return j.select(NET, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("b").alias("p"), (F.col("b") * F.col("tau")).alias("a"), (2 * F.col("b") * F.col("tau") * F.col("tau")).alias("c"))


def _times(x: tuple, y: tuple) -> tuple:
    """Moments of one time after another (numbers or columns)."""
    return x[0] * y[0], x[1] * y[0] + x[0] * y[1], x[2] * y[0] + 2 * x[1] * y[1] + x[0] * y[2]


def _loops(d, l: tuple) -> tuple:
    """Moments of any number of loops l, d being the probability to leave."""
    return 1 / d, l[1] / (d * d), l[2] / (d * d) + 2 * l[1] * l[1] / (d * d * d)


def remove_round(scratch: Scratch, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Removes one independent set of states that are not in keep(network_id, node)."""
    nb = edges.filter("src <> dst").select(NET, "src", "dst").union(edges.filter("src <> dst").select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    free = nb.groupBy(NET, F.col("src").alias("node")).agg(F.count("*").alias("deg")).join(keep, [NET, "node"], "left_anti")
    free = scratch.put(free.select(NET, "node", F.struct("deg", F.xxhash64("node").alias("h"), "node").alias("key")), "gt_free", keep=2)
    a, b = free.select(NET, F.col("node").alias("src"), F.col("key").alias("ka")), free.select(NET, F.col("node").alias("dst"), F.col("key").alias("kb"))
    beaten = nb.join(a, [NET, "src"]).join(b, [NET, "dst"]).filter("kb < ka").select(NET, F.col("src").alias("node"))
    gone = scratch.put(free.select(NET, "node").join(beaten, [NET, "node"], "left_anti"), "gt_gone", keep=2)
    at_src, at_dst = gone.select(NET, F.col("node").alias("src")), gone.select(NET, F.col("node").alias("dst"))
    out = edges.join(at_src, [NET, "src"], "left_semi")
    loop = out.filter("src = dst").select(NET, F.col("src").alias("x"), F.struct("p", "a", "c").alias("l"))
    leave = out.filter("src <> dst").groupBy(NET, F.col("src").alias("x")).agg(F.sum("p").alias("d"))
    h = leave.join(loop, [NET, "x"], "left")
    l = tuple(F.coalesce(F.col(f"l.{k}"), F.lit(0.0)) for k in "pac")
    h = h.select(NET, "x", *[c.alias(f"h{k}") for k, c in zip("pac", _loops(F.col("d"), l))])
    inn = edges.filter("src <> dst").join(at_dst, [NET, "dst"], "left_semi").select(NET, F.col("dst").alias("x"), F.col("src").alias("j"), *[F.col(k).alias(f"i{k}") for k in "pac"])
    onward = out.filter("src <> dst").select(NET, F.col("src").alias("x"), F.col("dst").alias("i"), *[F.col(k).alias(f"o{k}") for k in "pac"])
    j = inn.join(h, [NET, "x"]).join(onward, [NET, "x"])
    v = lambda s: tuple(F.col(f"{s}{k}") for k in "pac")
    new = _times(_times(v("i"), v("h")), v("o"))
    made = j.select(NET, F.col("j").alias("src"), F.col("i").alias("dst"), *[x.alias(k) for k, x in zip("pac", new)])
    rest = edges.join(at_src, [NET, "src"], "left_anti").join(at_dst, [NET, "dst"], "left_anti")
    return scratch.put(rest.unionByName(made).groupBy(NET, "src", "dst").agg(*[F.sum(k).alias(k) for k in "pac"]), "gt_edges", keep=2)


def eliminate(m: np.ndarray, kept: int) -> np.ndarray:
    """Dense form m[3, src, dst]: removes the states from the last one down to number ``kept``, in place.

    A block's states are removed one by one in its own rows and columns; all other entries get the block's sum as products of matrices.
    """
    hi = m.shape[1]
    while hi > kept:
        lo = max(kept, hi - BLOCK)
        on = np.zeros((3, hi - lo, lo))  # the ways on from the block's states, their loops included
        for x in range(hi - 1, lo - 1, -1):
            d = m[0, x, :x].sum()
            if d <= 0:
                continue
            h = _loops(d, m[:, x, x].copy())
            go = _times(h, tuple(m[:, x, :x]))
            for k in range(3):
                on[k, x - lo] = go[k][:lo]
            for rows, cols in ((slice(lo, x), slice(0, x)), (slice(0, lo), slice(lo, x))):
                new = _times(tuple(m[:, rows, x, None]), tuple(g[None, cols] for g in go))
                for k in range(3):
                    m[k, rows, cols] += new[k]
        i = m[:, :lo, lo:hi]
        m[0, :lo, :lo] += i[0] @ on[0]
        m[1, :lo, :lo] += np.hstack([i[1], i[0]]) @ np.vstack([on[0], on[1]])
        m[2, :lo, :lo] += np.hstack([i[2], 2 * i[1], i[0]]) @ np.vstack([on[0], on[1], on[2]])
        hi = lo
    return m[:, :kept, :kept]


def remove_sparse(out: list[dict], kept: np.ndarray, most: int = SPARSE, steps: list | None = None) -> list[int]:
    """Removes states that are not kept, those of fewest ways through them first, until each has more than ``most`` neighbours on both sides.

    out[src][dst] = (p, a, c), changed in place; rows of removed states are empty afterwards. Returns the states that are left.
    ``steps`` gets every removed state with its loop and the row that it had when it went.
    """
    inn: list[set] = [set() for _ in out]
    for x, row in enumerate(out):
        for y in row:
            inn[y].add(x)
    cost = lambda x: len(inn[x]) * len(out[x])
    queue = [(cost(x), x) for x in range(len(out)) if not kept[x]]
    heapq.heapify(queue)
    gone = np.zeros(len(out), bool)
    while queue:
        was, x = heapq.heappop(queue)
        if gone[x]:
            continue
        if was != cost(x):
            heapq.heappush(queue, (cost(x), x))
            continue
        if was > most * most:
            break
        row = out[x]
        loop = row.pop(x, (0.0, 0.0, 0.0))
        inn[x].discard(x)
        d = sum(v[0] for v in row.values())
        gone[x] = True
        if steps is not None:
            steps.append((x, loop, row))
        go = [(y, _times(_loops(d, loop), v)) for y, v in row.items()] if d > 0 else []
        for w in inn[x]:
            there = out[w]
            i = there.pop(x)
            for y, o in go:
                n = (i[0] * o[0], i[1] * o[0] + i[0] * o[1], i[2] * o[0] + 2 * i[1] * o[1] + i[0] * o[2])
                t = there.get(y)
                if t is None:
                    there[y] = n
                    inn[y].add(w)
                else:
                    there[y] = (t[0] + n[0], t[1] + n[1], t[2] + n[2])
        for y in row:
            inn[y].discard(x)
        out[x], inn[x] = {}, set()
    return list(np.flatnonzero(~gone))


def _reduce_matrix(n: int, s: np.ndarray, d: np.ndarray, moments: np.ndarray, kept: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``reduce_one`` of the states ``left``, those kept first."""
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    m = np.zeros((3, len(left), len(left)))
    m[:, place[s], place[d]] = moments
    m = eliminate(m, int(kept[left].sum()))
    x, y = np.nonzero(m[0])
    return left[x], left[y], m[:, x, y]


def reduce_one(n: int, s: np.ndarray, d: np.ndarray, moments: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, moments[3, ..]) among the kept of n states."""
    alive = np.unique(np.r_[s, d])
    if 4 * len(s) > len(alive) ** 2:  # no state of few neighbours to be found
        return _reduce_matrix(n, s, d, moments, kept, alive[np.argsort(~kept[alive], kind="stable")])
    out: list[dict] = [{} for _ in range(n)]
    for x, y, *v in zip(s.tolist(), d.tolist(), *(k.tolist() for k in moments)):
        out[x][y] = tuple(v)
    left = np.array(remove_sparse(out, kept), int)
    free = np.zeros(n, bool)
    free[left] = ~kept[left]
    touch = free.copy()  # the matrix has the states to be removed and their neighbours; edges among the others stay as they are
    for x in left:
        y = np.fromiter(out[x], int, len(out[x]))
        if free[x]:
            touch[y] = True
        elif free[y].any():
            touch[x] = True
    stay = [(x, y, v) for x in left.tolist() for y, v in out[x].items() if not (touch[x] and touch[y])]
    left = left[touch[left]]
    left = left[np.lexsort(([-len(out[x]) for x in left], ~kept[left]))]  # kept states first, then those of many ways; removal starts at the end
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    m = np.zeros((3, len(left), len(left)))
    for x in left:
        row, out[x] = out[x], {}
        at = place[np.fromiter(row, int, len(row))]
        if (at >= 0).any():
            m[:, place[x], at[at >= 0]] = np.array(list(row.values()))[at >= 0].T
    m = eliminate(m, int(kept[left].sum()))
    x, y = np.nonzero(m[0])
    s, d = np.array([(a, b) for a, b, _ in stay], int).reshape(-1, 2).T
    return np.r_[left[x], s], np.r_[left[y], d], np.c_[m[:, x, y], np.array([v for *_, v in stay], float).reshape(-1, 3).T]


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    names, inv = np.unique(np.r_[pdf["src"], pdf["dst"]], return_inverse=True)
    n = len(pdf)
    kept = np.zeros(len(names), bool)
    kept[inv[:n][pdf["keep_src"].to_numpy(bool)]] = True
    kept[inv[n:][pdf["keep_dst"].to_numpy(bool)]] = True
    s, d, m = reduce_one(len(names), inv[:n], inv[n:], pdf[list("pac")].to_numpy().T, kept)
    return pd.DataFrame({NET: pdf[NET].iloc[0], "src": names[s], "dst": names[d], **dict(zip("pac", m))})


def transform(scratch: Scratch, edges: DataFrame, keep: DataFrame, dense: int = LOCAL) -> DataFrame:
    """Edges among the kept states: keep(network_id, node) of connected networks. Self-loops may remain.

    Networks without kept states vanish. Means and variances of passage times between kept states are unchanged.
    """
    edges = scratch.put(edges, "gt_edges", keep=2)
    keep = scratch.put(keep.select(NET, "node").distinct(), "gt_keep")
    while True:
        nodes = edges.select(NET, F.col("src").alias("node")).union(edges.select(NET, F.col("dst").alias("node"))).distinct()
        free = nodes.join(keep, [NET, "node"], "left_anti")
        size = free.groupBy(NET).agg(F.count("*").alias("n"))
        near = edges.join(free.withColumnRenamed("node", "src"), [NET, "src"], "left_semi").groupBy(NET).agg(F.count_distinct("dst").alias("m"), F.count("*").alias("e"))
        big = size.join(near, NET, "left").filter((F.col("n") > dense) | (F.col("m") > max(4 * dense // 3, 64)) | (F.col("e") > LOCAL_EDGES)).select(NET)
        if big.limit(1).count() == 0:
            break
        large = edges.join(big, NET, "left_semi")
        small = edges.join(big, NET, "left_anti")
        edges = scratch.put(remove_round(scratch, large, keep).unionByName(small), "gt_edges", keep=3)
    flag = lambda c: keep.select(NET, F.col("node").alias(c), F.lit(True).alias(f"keep_{c}"))
    near = edges.join(flag("src"), [NET, "src"], "left").join(flag("dst"), [NET, "dst"], "left").fillna(False, ["keep_src", "keep_dst"])
    # edges between kept states need no matrix: only those at a removed one do, at most ``dense`` states and their neighbours
    touch = near.filter("NOT (keep_src AND keep_dst)")
    near_cols = [NET, "src", "dst", "p", "a", "c", "keep_src", "keep_dst"]
    made = by_network(touch.select(*near_cols)).applyInPandas(_finish, EDGES)
    done = near.filter("keep_src AND keep_dst").select(NET, "src", "dst", "p", "a", "c")
    return done.unionByName(made).groupBy(NET, "src", "dst").agg(*[F.sum(k).alias(k) for k in "pac"])


def eliminate_one(branches: DataFrame, tau: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One state per network removed by joins: victims(network_id, x). Returns (branches, tau) of the others."""
    e = branches.join(victims, NET)
    away = e.filter("src = x AND dst <> x")
    d = away.groupBy(NET).agg(F.sum("b").alias("d"))
    out = away.select(NET, F.col("dst").alias("i"), F.col("b").alias("bo"))
    inn = e.filter("dst = x AND src <> x").select(NET, F.col("src").alias("j"), F.col("b").alias("bi"))
    made = inn.join(d, NET).join(out, NET).select(NET, F.col("j").alias("src"), F.col("i").alias("dst"), (F.col("bi") / F.col("d") * F.col("bo")).alias("b"))
    b = e.filter("src <> x AND dst <> x").select(NET, "src", "dst", "b").unionByName(made).groupBy(NET, "src", "dst").agg(F.sum("b").alias("b"))
    tx = tau.join(victims, NET).filter("node = x").select(NET, F.col("tau").alias("tx"))
    extra = inn.join(d, NET).join(tx, NET).select(NET, F.col("j").alias("node"), (F.col("bi") / F.col("d") * F.col("tx")).alias("more"))
    t = tau.join(victims, NET).filter("node <> x").join(extra, [NET, "node"], "left").select(NET, "node", (F.col("tau") + F.coalesce("more", F.lit(0.0))).alias("tau"))
    return b, t


def passage(scratch: Scratch, edges: DataFrame, ab: DataFrame) -> DataFrame:
    """mean and var of the first passage from A to B and back for single-state sets: network_id, mfpt_ab, var_ab, mfpt_ba, var_ba.

    All other states are removed; then the way is any number of loops and one jump.
    """
    e = transform(scratch, edges, ab.select(NET, F.col("min_id").alias("node")))
    s = ab.select(NET, F.col("min_id").alias("src"), F.col("side").alias("from"))
    e = e.join(s, [NET, "src"])
    loop = e.filter("src = dst").select(NET, "from", *[F.col(k).alias(f"l{k}") for k in "pac"])
    go = e.filter("src <> dst").select(NET, "from", *[F.col(k).alias(f"g{k}") for k in "pac"])
    j = go.join(loop, [NET, "from"], "left").fillna(0.0, ["lp", "la", "lc"])
    h = _loops(F.col("gp"), tuple(F.col(f"l{k}") for k in "pac"))
    _, m1, m2 = _times(h, tuple(F.col(f"g{k}") for k in "pac"))
    t = j.select(NET, "from", m1.alias("m"), (m2 - m1 * m1).alias("v"))
    side = lambda x, c: F.max(F.when(F.col("from") == x, F.col(c)))
    return t.groupBy(NET).agg(side("A", "m").alias("mfpt_ab"), side("A", "v").alias("var_ab"), side("B", "m").alias("mfpt_ba"), side("B", "v").alias("var_ba"))


def stationary(edges: DataFrame, pi: DataFrame, tau: DataFrame) -> DataFrame:
    """Stationary distribution of a reduced model: network_id, node, pi_restricted, pi_eff, tau_eff.

    A kept state is visited pi / tau times a unit of time before and after the transformation; a jump now takes the mean
    time tau_eff, so pi_eff is pi tau_eff / tau. pi_restricted is pi over its sum over the kept states.
    """
    t = edges.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau_eff"))
    x = t.join(pi.select(NET, "node", "pi"), [NET, "node"]).join(tau.select(NET, "node", "tau"), [NET, "node"]).withColumn("w", F.col("pi") * F.col("tau_eff") / F.col("tau"))
    total = x.groupBy(NET).agg(F.sum("w").alias("tw"), F.sum("pi").alias("tp"))
    return x.join(total, NET).select(NET, "node", (F.col("pi") / F.col("tp")).alias("pi_restricted"), (F.col("w") / F.col("tw")).alias("pi_eff"), "tau_eff")


def reduced_generator(edges: DataFrame) -> DataFrame:
    """Entries (network_id, src, dst, q) of the generator of transformed edges."""
    tau = edges.groupBy(NET, "src").agg(F.sum("a").alias("tau"))
    k = edges.filter("src <> dst").join(tau, [NET, "src"]).select(NET, "src", "dst", (F.col("p") / F.col("tau")).alias("q"))
    return k.unionByName(k.groupBy(NET, "src").agg((-F.sum("q")).alias("q")).select(NET, "src", F.col("src").alias("dst"), "q"))


def set_kinetics(scratch: Scratch, edges: DataFrame, pi: DataFrame, ab: DataFrame) -> DataFrame:
    """Passage times and rates between sets of states, both ways: network_id, n_a, n_b, and for ab and ba mfpt, k_ss, k_nss, k_f, k_star.

    With source set S, target set T and weights w = pi / pi(S): mfpt is the weighted mean of the states' times to T, k_star its
    inverse, k_f the weighted mean of the inverse times. With c the probability of a state of S to meet T before S again,
    k_ss is the weighted sum of c / tau with the state's own waiting time, k_nss the one with its waiting time after all
    states outside both sets have been removed. pi holds the full distribution. An empty set gives nulls.
    """
    size = ab.groupBy(NET).agg(F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"))
    both = size.filter("n_a > 0 AND n_b > 0").select(NET)
    edges, out = scratch.put(edges.join(both, NET, "left_semi"), "sk_edges"), size
    keep = ab.select(NET, F.col("min_id").alias("node"))
    small = scratch.put(transform(scratch, edges, keep), "sk_small")
    tau = edges.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau"))
    tau_eff = small.groupBy(NET, F.col("src").alias("node")).agg(F.sum("a").alias("tau_eff"))
    for way, start, goal in (("ab", "A", "B"), ("ba", "B", "A")):
        turned = ab.select(NET, "min_id", F.when(F.col("side") == goal, "B").otherwise("A").alias("side"))
        m = committor_mfpt(small, turned).select(NET, "node", F.col("mfpt_to_b").alias("m"))
        src = ab.filter(F.col("side") == start).select(NET, F.col("min_id").alias("node"))
        dst = ab.filter(F.col("side") == goal).select(NET, F.col("min_id").alias("dst"))
        c = small.join(dst, [NET, "dst"], "left_semi").groupBy(NET, F.col("src").alias("node")).agg(F.sum("p").alias("c"))
        x = src.join(pi.select(NET, "node", "pi"), [NET, "node"]).join(m, [NET, "node"]).join(tau, [NET, "node"]).join(tau_eff, [NET, "node"]).join(c, [NET, "node"], "left").fillna(0.0, ["c"])
        w = lambda v: F.sum(F.col("pi") * v) / F.sum("pi")
        g = x.groupBy(NET).agg(w(F.col("m")).alias(f"mfpt_{way}"), w(F.col("c") / F.col("tau")).alias(f"k_ss_{way}"), w(F.col("c") / F.col("tau_eff")).alias(f"k_nss_{way}"), w(1 / F.col("m")).alias(f"k_f_{way}"))
        out = out.join(g.withColumn(f"k_star_{way}", 1 / F.col(f"mfpt_{way}")), NET, "left")
    return out


def _local(fn, dense: int):
    """Runs fn(names, P, tau) on one reduced network of at most ``dense`` kept states."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[pdf["src"], pdf["dst"]])
        if len(names) > dense:
            raise ValueError(f"{pdf[NET].iloc[0]}: {len(names)} states are left; reduce to at most {dense} first")
        s, d = np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])
        p, a = (np.zeros((len(names), len(names))) for _ in range(2))
        p[s, d], a[s, d] = pdf["p"], pdf["a"]
        sides = {k: np.isin(names, pdf["src"][pdf["side"] == k]) for k in "AB"}
        out = fn(names, p, a.sum(1), sides)
        return pd.DataFrame({NET: pdf[NET].iloc[0], **out})

    return run


def _with_side(edges: DataFrame, ab: DataFrame) -> DataFrame:
    return edges.join(ab.select(NET, F.col("min_id").alias("src"), "side"), [NET, "src"], "left").select(NET, "src", "dst", "p", "a", "side")


def _committor(names, p, tau, sides):
    n = len(names)
    a, b = sides["A"], sides["B"]
    q = b.astype(float)
    free = ~(a | b)
    if free.any():
        q[free] = np.linalg.solve(np.eye(free.sum()) - p[np.ix_(free, free)], p[np.ix_(free, b)].sum(1))
    m = np.zeros(n)
    if (~b).any() and b.any():
        m[~b] = np.linalg.solve(np.eye((~b).sum()) - p[np.ix_(~b, ~b)], tau[~b])
    return {"node": names, "committor": np.clip(q, 0, 1), "mfpt_to_b": np.maximum(m, 0)}


def committor_mfpt(edges: DataFrame, ab: DataFrame, dense: int = 4 * DENSE) -> DataFrame:
    """On networks of at most ``dense`` states: q (probability to reach B before A) and m (mean time to B) of every state."""
    return by_network(_with_side(edges, ab)).applyInPandas(_local(_committor, dense), "network_id string, node long, committor double, mfpt_to_b double")


def committor_all(scratch: Scratch, edges: DataFrame, ab: DataFrame, dense: int = 4 * DENSE) -> DataFrame:
    """committor_mfpt of every state of connected networks of any size.

    Larger networks lose states in rounds, as in ``transform``, until ``dense`` are left. The branches that a state
    had when it went give its values from those of its targets, last round first.
    """
    keep = scratch.put(ab.select(NET, F.col("min_id").alias("node")), "ca_keep")
    gone = []
    while True:
        big = edges.groupBy(NET).agg(F.count_distinct("src").alias("n")).filter(F.col("n") > dense).select(NET)
        if big.limit(1).count() == 0:
            break
        large, small = edges.join(big, NET, "left_semi"), edges.join(big, NET, "left_anti")
        less = remove_round(scratch, large, keep)
        gone.append(scratch.put(large.join(less.select(NET, "src").distinct(), [NET, "src"], "left_anti"), "ca_gone"))
        edges = scratch.put(less.unionByName(small), "ca_edges", keep=2)
    values = scratch.put(committor_mfpt(edges, ab, dense), "ca_values")
    for out in reversed(gone):
        way = out.filter("src <> dst").join(values.withColumnRenamed("node", "dst"), [NET, "dst"]).groupBy(NET, "src").agg(F.sum("p").alias("d"), F.sum(F.col("p") * F.col("committor")).alias("q"), F.sum(F.col("p") * F.col("mfpt_to_b")).alias("m"))
        time = out.groupBy(NET, "src").agg(F.sum("a").alias("t"))
        new = way.join(time, [NET, "src"]).select(NET, F.col("src").alias("node"), (F.col("q") / F.col("d")).alias("committor"), ((F.col("m") + F.col("t")) / F.col("d")).alias("mfpt_to_b"))
        values = scratch.put(values.unionByName(new), "ca_values", keep=2)
    return values


def slow_modes(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, escape: np.ndarray, k: int, most: int = 20_000, vectors: bool = False):
    """The k + 1 least eigenvalues of diag(escape) - W, W symmetric with entries w at (s, d), without a dense matrix; with ``vectors`` also theirs.

    Blocks of the current vectors, their residuals over the diagonal and the last steps (LOBPCG), until every residual
    is below 1e-6 of its eigenvalue, so that eigenvalues are exact to about 1e-12 of it.
    """
    order = np.lexsort((d, s))
    s, d, w = s[order], d[order], w[order]
    first, rows = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), np.unique(s)

    def times(x):
        out = escape[:, None] * x
        for c in range(x.shape[1]):
            out[rows, c] -= np.add.reduceat(w * x[d, c], first)
        return out

    want = k + 1
    m = min(want + 5, n)
    x = np.random.default_rng(0).normal(size=(n, m)) / np.sqrt(n) * 0.1
    x[np.argsort(escape)[:m], np.arange(m)] += 1.0  # slow modes sit on states that are slow to leave
    x, step = np.linalg.qr(x)[0], np.zeros((n, 0))
    floor = 1e-13 * escape.max()
    for _ in range(most):
        ax = times(x)
        value, turn = np.linalg.eigh(x.T @ ax)
        x, ax = x @ turn, ax @ turn
        rest = ax - x * value
        if np.all(np.linalg.norm(rest, axis=0)[:want] <= np.maximum(1e-6 * np.abs(value[:want]), floor)):
            return (value[:want], x[:, :want]) if vectors else value[:want]
        new = rest / escape[:, None]
        basis = np.c_[x, new / np.maximum(np.linalg.norm(new, axis=0), 1e-300), step]
        basis = np.linalg.qr(basis)[0]
        _, y = np.linalg.eigh(basis.T @ times(basis))
        last = basis @ y[:, :m]
        step = last - x @ (x.T @ last)
        step = step / np.maximum(np.linalg.norm(step, axis=0), 1e-300)
        x = np.linalg.qr(last)[0]
    raise ValueError(f"slow modes of {n} states have not converged in {most} steps")


def sparse_solver(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, diag: np.ndarray, most: int = SPARSE, core: int = CORE):
    """b[n, ..] -> A^-1 b for A = diag - W, W symmetric with entries w at (s, d): states of few neighbours one by one, the inverse of the rest as a matrix.

    None where more than ``core`` states are left for the matrix.
    """
    near: list[dict] = [{} for _ in range(n)]
    for x, y, v in zip(s.tolist(), d.tolist(), w.tolist()):
        near[x][y] = v
    diag, steps, gone = diag.tolist(), [], np.zeros(n, bool)
    queue = [(len(r), x) for x, r in enumerate(near)]
    heapq.heapify(queue)
    while queue:
        was, x = heapq.heappop(queue)
        if gone[x]:
            continue
        row = near[x]
        if was != len(row):
            heapq.heappush(queue, (len(row), x))
            continue
        if was > most:
            break
        gone[x] = True
        ways = [(y, v / diag[x], v) for y, v in row.items()]
        for y, u, v in ways:
            there = near[y]
            del there[x]
            diag[y] -= u * v
            for z, _, t in ways:
                if z != y:
                    there[z] = there.get(z, 0.0) + u * t
        steps.append((x, np.fromiter(row, int, was), np.array([u for _, u, _ in ways])))
        near[x] = {}
    left = np.flatnonzero(~gone)
    if len(left) > core:
        return None
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    m = np.diag(np.array(diag)[left])
    for x in left:
        if near[x]:
            m[place[x], place[np.fromiter(near[x], int, len(near[x]))]] = -np.fromiter(near[x].values(), float, len(near[x]))
    m = np.linalg.inv(m)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for x, y, u in steps:
            b[y] += u[:, None] * b[x]
        b[left] = m @ b[left]
        for x, y, u in reversed(steps):
            b[x] = b[x] / diag[x] + u @ b[y]
        return b

    return solve


def slow_modes_inverse(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, escape: np.ndarray, k: int, most: int = 60) -> np.ndarray | None:
    """The eigenvalues of ``slow_modes`` by inverse iteration of a block of vectors, to the same residuals; None if they have not settled in ``most`` steps or leave too large a matrix."""
    order = np.lexsort((d, s))
    s, d, w = s[order], d[order], w[order]
    first, rows = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), np.unique(s)

    def times(x):
        out = escape[:, None] * x
        out[rows] -= np.add.reduceat(w[:, None] * x[d], first)
        return out

    want, floor = k + 1, 1e-13 * escape.max()
    solve = sparse_solver(n, s, d, w, escape + 1e-8 * escape.max())
    if solve is None:
        return None
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(3 * want + 6, n))))[0]
    for _ in range(most):
        x = np.linalg.qr(solve(x))[0]
        ax = times(x)
        value, turn = np.linalg.eigh(x.T @ ax)
        x, ax = x @ turn, ax @ turn
        if np.all(np.linalg.norm(ax - x * value, axis=0)[:want] <= np.maximum(1e-6 * np.abs(value[:want]), floor)):
            return value[:want]
    return None


def slowest(n: int, s: np.ndarray, d: np.ndarray, p: np.ndarray, a: np.ndarray, k: int, dense: int = 4 * DENSE, name: str = "network") -> np.ndarray:
    """``spectrum`` of one network of n states."""
    tau = np.bincount(s, a, n)
    s, d, p = (x[s != d] for x in (s, d, p))
    rate = p / tau[s]
    escape = np.bincount(s, rate, n)
    there, back = np.lexsort((d, s)), np.lexsort((s, d))  # the same pairs, one way and the other
    if not (np.array_equal(s[there], d[back]) and np.array_equal(d[there], s[back])):
        raise ValueError(f"{name}: an edge has no way back, the chain is not reversible")
    s, d, w = s[there], d[there], np.sqrt(rate[there] * rate[back])
    if n <= dense:
        m = np.diag(escape)
        m[s, d] -= w
        ev = np.linalg.eigvalsh(m)
    else:
        ev = slow_modes_inverse(n, s, d, w, escape, k)
        ev = slow_modes(n, s, d, w, escape, k) if ev is None else ev
    return -ev[ev > 1e-12][:k]


def spectrum(edges: DataFrame, ab: DataFrame | None = None, k: int = 10, dense: int = 4 * DENSE) -> DataFrame:
    """The k slowest modes of each network: eigenvalues of (P - 1)/tau below zero, nearest first, and times -1/lambda.

    The chains are reversible, so the geometric mean of both directions' rates has the same eigenvalues and is
    symmetric. Up to ``dense`` states take one matrix, more of them a sparse factor or the edges only. ab has no part in it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, name = np.unique(np.r_[pdf["src"], pdf["dst"]]), pdf[NET].iloc[0]
        s, d = np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])
        ev = slowest(len(names), s, d, pdf["p"].to_numpy(), pdf["a"].to_numpy(), k, dense, name)
        return pd.DataFrame({NET: name, "mode": np.arange(1, len(ev) + 1), "lambda": ev, "t": -1 / ev})

    return by_network(edges.select(NET, "src", "dst", "p", "a")).applyInPandas(run, "network_id string, mode int, lambda double, t double")


def spectral_features(modes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Seven features of a network's slow modes (``spectrum``) and its edges.

    gap and fiedler are -lambda_1; gap_ratio is lambda_1 / lambda_2 and gap_ratio_inv its inverse (null with one mode);
    ramanujan_score is gap / (2 sqrt(d - 1)) with the mean degree d, at least 2; entropy is that of the first k
    eigenvalues' shares, effective_dimension its exponential. Networks without a mode below zero have nulls.
    """
    degree = edges.groupBy(NET, "src").agg(F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("d")).groupBy(NET).agg(F.greatest(F.lit(2.0), F.avg("d")).alias("degree"))
    at = lambda i: F.max(F.when(F.col("mode") == i, F.col("lambda")))
    x = F.when(F.col("mode") <= k, F.abs("lambda"))
    # -sum p ln p with p = x / sum x
    m = modes.groupBy(NET).agg(at(1).alias("l1"), at(2).alias("l2"), (F.ln(F.sum(x)) - F.sum(x * F.ln(x)) / F.sum(x)).alias("entropy"))
    j = degree.join(m, NET, "left")
    gap = -F.col("l1")
    return j.select(NET, gap.alias("gap"), (F.col("l1") / F.col("l2")).alias("gap_ratio"), (F.col("l2") / F.col("l1")).alias("gap_ratio_inv"), gap.alias("fiedler"),
        (gap / (2 * F.sqrt(F.col("degree") - 1))).alias("ramanujan_score"), "entropy", F.exp("entropy").alias("effective_dimension"))
