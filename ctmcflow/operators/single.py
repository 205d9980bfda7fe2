"""One network in one task, from its minima and transition states to the row that a query wants of it.

The same relations and rules as in ``ctmc``, ``graph``, ``reduce`` and ``community``, on arrays. What these would treat in a
special way (gaps, repeated minima, rates that are no positive numbers, networks beyond the limits of one task) raises
``Joined``: such a network goes through the joins.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd

from ctmcflow.operators import community, graph, reduce
from ctmcflow.operators.graph import NET

MOST_TS = 1_000_000  # transition states of a network that one task takes


class Joined(Exception):
    """The network is left to the joins."""


class Net:
    """States have numbers in the order of their names; those of the largest component (core) numbers of their own."""

    def __init__(self, minima: pd.DataFrame, ts: pd.DataFrame):
        m = minima.sort_values("min_id")
        self.names, self.energy, self.log_prod = (m[c].to_numpy() for c in ("min_id", "energy", "log_prod"))
        if m.isna().to_numpy().any() or ts.isna().to_numpy().any() or (self.names[1:] == self.names[:-1]).any():
            raise Joined
        n = len(self.names)
        f, i = ts["f"].to_numpy("int64"), ts["i"].to_numpy("int64")
        t = ts[(f != i) & np.isin(f, self.names) & np.isin(i, self.names)]
        self.f, self.i = (np.searchsorted(self.names, t[c].to_numpy("int64")) for c in "fi")
        self.e_ts = t["e_ts"].to_numpy()
        up = [np.exp(-(self.e_ts - self.energy[x]) + self.log_prod[x] - t["s_ts"].to_numpy()) for x in (self.f, self.i)]
        at, inv = np.unique(np.r_[self.f * n + self.i, self.i * n + self.f], return_inverse=True)
        self.s, self.d, self.k = at // max(n, 1), at % max(n, 1), np.bincount(inv.reshape(-1), np.r_[up[0], up[1]], len(at))
        if not (np.isfinite(self.k).all() and (self.k > 0).all()):
            raise Joined

    @cached_property
    def core(self) -> np.ndarray:
        root = graph.roots(len(self.names), self.s, self.d)
        return np.flatnonzero(root == np.bincount(root).argmax())

    @cached_property
    def place(self) -> np.ndarray:
        at = np.full(len(self.names), -1)
        at[self.core] = np.arange(len(self.core))
        return at

    @cached_property
    def micro(self) -> tuple:
        """(number of states, src, dst, moments) of the core."""
        n, on = len(self.core), self.place[self.s] >= 0
        s, d, k = self.place[self.s[on]], self.place[self.d[on]], self.k[on]
        tau = 1 / np.bincount(s, k, n)[s]
        b = k * tau
        return n, s, d, np.array([b, b * tau, 2 * b * tau * tau])

    @property
    def empty(self) -> bool:
        return len(self.s) == 0

    @cached_property
    def tau(self) -> np.ndarray:
        n, s, _, m = self.micro
        return np.bincount(s, m[1], n)

    @cached_property
    def pi(self) -> np.ndarray:
        return equilibrium(self.energy[self.core], self.log_prod[self.core])

    @cached_property
    def low(self) -> np.ndarray:
        """The core's states by energy, then name."""
        return np.lexsort((np.arange(len(self.core)), self.energy[self.core]))

    @property
    def ab(self) -> np.ndarray:
        return self.low[:2]

    def reduce(self, kept: np.ndarray, model: tuple | None = None) -> tuple:
        """(src, dst, moments) among the kept of the core's states, from the core or from a model (src, dst, moments) of it."""
        n, *micro = self.micro
        s, d, m = model or micro
        alive = np.zeros(n, bool)
        alive[s] = alive[d] = True
        gone = alive & ~kept
        if gone.sum() > reduce.LOCAL or (gone[s] | gone[d]).sum() > reduce.LOCAL_EDGES and model is None:
            raise Joined
        return reduce.reduce_one(n, s, d, m, kept)

    def hybrid(self, percent: float = 5.0, min_kept: int = 50) -> np.ndarray:
        """``ctmc.keep_states``: which states the hybrid rule keeps."""
        pi, tau, p = self.pi, self.tau, percent / 100.0
        fe, must = -np.log(np.maximum(pi, 1e-300)), np.zeros(len(pi), bool)
        must[self.ab] = True
        if must.all():
            return must
        drop = ~must & (fe > quantile(fe[~must], p)) & (tau < quantile(tau[~must], 1 - p))
        kept = ~drop
        back = np.flatnonzero(drop)
        back = back[np.lexsort((back, -pi[back]))]
        kept[back[: max(0, max(min_kept, 2) - int(kept.sum()))]] = True
        return kept

    @cached_property
    def reduced(self) -> tuple:
        return self.reduce(self.hybrid())

    def passage(self, model: tuple | None = None) -> dict:
        """``reduce.passage`` between A and B."""
        kept = np.zeros(len(self.core), bool)
        kept[self.ab] = True
        s, d, m = self.reduce(kept, model)
        out = {}
        for way, x in zip(("ab", "ba"), self.ab):
            loop, go = (m[:, (s == x) & (on)].sum(1) for on in (d == s, d != s))
            if go[0] > 0:
                _, m1, m2 = reduce._times(reduce._loops(go[0], tuple(loop)), tuple(go))
                out |= {f"mfpt_{way}": m1, f"var_{way}": m2 - m1 * m1}
        return out


def equilibrium(energy: np.ndarray, log_prod: np.ndarray) -> np.ndarray:
    x = -energy - log_prod
    w = np.exp(x - x.max())
    return w / w.sum()


def quantile(x: np.ndarray, p: float) -> float:
    """With linear interpolation, as ``stats.quantiles`` has it."""
    x = np.sort(x)
    at = p * (len(x) - 1)
    lo = int(np.floor(at))
    return x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (at - lo)


def modes(net: Net, model: tuple, k: int = 10) -> np.ndarray:
    """``reduce.spectrum`` of a model of the core."""
    s, d, m = model
    names, inv = np.unique(np.r_[s, d], return_inverse=True)
    return reduce.slowest(len(names), inv[: len(s)], inv[len(s) :], m[0], m[1], k)


def _rel(s: np.ndarray, d: np.ndarray, q: np.ndarray, pi: np.ndarray) -> tuple:
    """Norms of Q pi and |Q| pi, and their ratio."""
    a, b = np.abs(np.bincount(d, q * pi[s], len(pi))).sum(), (np.abs(q) * pi[s]).sum()
    return a, b, a / b if b else None


def eigengap(net: Net):
    gap = -np.diff(modes(net, net.reduced))
    if len(gap):
        return {"largest_gap": gap.max(), "after_mode": int(gap.argmax()) + 1, "gaps": len(gap)}


def gt_stationary(net: Net):
    s, d, m = net.reduced
    n = len(net.core)
    tau, seen = np.bincount(s, m[1], n), np.zeros(n, bool)
    seen[s] = True
    off = s != d
    x, y, k = s[off], d[off], m[0][off] / tau[s[off]]
    at = np.flatnonzero(seen)
    out = np.bincount(x, k, n)[at]
    q = np.r_[x, at], np.r_[y, at], np.r_[k, -out]
    w = np.where(seen, net.pi * tau / net.tau, 0)
    p = np.where(seen, net.pi, 0)
    rel = [_rel(*q, v / v.sum())[2] for v in (p, w)]
    return {"n_eff": len(at), "rel_pi_restricted": rel[0], "rel_pi_eff": rel[1]}


def spectral_communities(net: Net):
    s, d, m = net.reduced
    tau, off = np.bincount(s, m[1]), s != d
    k = m[0][off] / tau[s[off]]
    s, d = s[off], d[off]
    order = np.lexsort((d, s))
    s, d, k = s[order], d[order], k[order]
    names, inv = np.unique(np.r_[s, d], return_inverse=True)
    if not len(names):
        return None
    x, y = inv[: len(s)].astype("int64"), inv[len(s) :].astype("int64")
    lab = community.spectral_labels(len(names), x, y, k, 10, 4 * reduce.DENSE)
    n, a, b = int(lab.max()) + 1, lab[x], lab[y]
    deg, inside = np.bincount(a, k / 2, n) + np.bincount(b, k / 2, n), np.bincount(a, np.where(a == b, k, 0), n)
    size = np.bincount(lab)
    p, t = size[size > 0] / len(lab), deg.sum()
    side = lab[np.isin(names, net.ab)]
    return {"n_communities": len(p), "community_size_entropy": -(p * np.log(p)).sum(), "largest_community_frac": p.max(), "modularity": (inside / t - (deg / t) ** 2).sum(), "ab_same_community": int(len(side) == 2 and side[0] == side[1])}


def ab_set_kinetics(net: Net, most: int = 3):
    a, b = net.low[:most], net.low[most : 2 * most]
    out = {"n_a": len(a), "n_b": len(b)}
    if not len(b):
        return out
    kept = np.zeros(len(net.core), bool)
    kept[a] = kept[b] = True
    s, d, m = net.reduce(kept)
    names = np.flatnonzero(kept)
    x, y = np.searchsorted(names, s), np.searchsorted(names, d)
    p, t = (np.zeros((len(names), len(names))) for _ in range(2))
    p[x, y], t[x, y] = m[0], m[1]
    tau_eff = t.sum(1)
    for way, start, goal in (("ab", a, b), ("ba", b, a)):
        sides = {"A": np.isin(names, start), "B": np.isin(names, goal)}
        at = np.searchsorted(names, start)
        mean = reduce._committor(names, p, tau_eff, sides)["mfpt_to_b"][at]
        c = p[np.ix_(at, np.searchsorted(names, goal))].sum(1)
        pi = net.pi[start] / net.pi[start].sum()
        mfpt = (pi * mean).sum()
        out |= {f"mfpt_{way}": mfpt, f"k_ss_{way}": (pi * c / net.tau[start]).sum(), f"k_nss_{way}": (pi * c / tau_eff[at]).sum(), f"k_f_{way}": (pi / mean).sum(), f"k_star_{way}": 1 / mfpt}
    return out


def gt_validate(net: Net):
    part = {f"{k}_c": v for k, v in net.passage(net.reduced).items()}
    return net.passage() | part | {"n_micro": len(net.core), "n_coarse": len(np.unique(net.reduced[0]))}


def micro_report_built(net: Net):
    n = len(net.names)
    at = np.unique(net.s)
    escape = np.bincount(net.s, net.k, n)
    s, d, q = np.r_[net.s, at], np.r_[net.d, at], np.r_[net.k, -escape[at]]
    pi = equilibrium(net.energy, net.log_prod)
    low = net.names[np.lexsort((net.names, net.energy))[:2]]
    norm = _rel(s, d, q, pi)
    return {
        "max_abs_colsum": np.abs(np.bincount(s, q, n)).max(), "n": len(at), "max_abs_rowsum": np.abs(np.bincount(d, q, n)).max(), "nnz": len(q), "diag_pos_count": int(((s == d) & (q > 1e-12)).sum()), "off_neg_count": int(((s != d) & (q < -1e-12)).sum()),
        "nnz_per_state": len(q) / len(at), "pi_sum": pi.sum(), "pi_min": pi.min(), "pi_max": pi.max(), "qpi_norm1": norm[0], "absqpi_norm1": norm[1], "qpi_rel": norm[2], "na": 1, "nb": len(low) - 1, "ab_overlap": 0, "a_index": low[0], "b_index": low[1],
    } | net.passage()


def spectral_features(net: Net, k: int = 10):
    ev = np.abs(modes(net, net.reduced, k))
    s, d, _ = net.reduced
    degree = max(2.0, (s != d).sum() / len(np.unique(s)))
    if not len(ev):
        return {}
    p = ev / ev.sum()
    entropy = np.log(ev.sum()) - (ev * np.log(ev)).sum() / ev.sum()
    more = {"gap_ratio": ev[0] / ev[1], "gap_ratio_inv": ev[1] / ev[0]} if len(p) > 1 else {}
    return {"gap": ev[0], "fiedler": ev[0], "ramanujan_score": ev[0] / (2 * np.sqrt(degree - 1)), "entropy": entropy, "effective_dimension": np.exp(entropy)} | more


def ab_kinetics(net: Net):
    return net.passage()


def gt_reduce(net: Net):
    s, _, m = net.reduced
    at, place = np.unique(s, return_inverse=True)
    return pd.DataFrame({"node": net.names[net.core[at]], "tau_eff": np.bincount(place, m[1]), "b_out": np.bincount(place, m[0]), "n_out": np.bincount(place)})


def spectrum(net: Net, k: int = 10):
    """``reduce.spectrum`` of the core as it is."""
    _, *micro = net.micro
    ev = modes(net, tuple(micro), k)
    return pd.DataFrame({"mode": np.arange(1, len(ev) + 1), "lambda": ev, "t": -1 / ev})


def committor_mfpt(net: Net, dense: int = 4 * reduce.DENSE):
    """``reduce.committor_mfpt`` of the core. Beyond ``dense`` states, those of few neighbours go first and get their values back, last one first, from the states that they led to."""
    n, s, d, m = net.micro
    steps, left = [], np.arange(n)
    if n > dense:
        kept = np.zeros(n, bool)
        kept[net.ab] = True
        if n - kept.sum() > reduce.LOCAL or len(s) > reduce.LOCAL_EDGES:
            raise Joined
        out: list[dict] = [{} for _ in range(n)]
        for x, y, *v in zip(s.tolist(), d.tolist(), *(k.tolist() for k in m)):
            out[x][y] = tuple(v)
        left = np.array(reduce.remove_sparse(out, kept, steps=steps), int)
        if len(left) > dense:
            raise Joined
        s, d = np.array([(x, y) for x in left.tolist() for y in out[x]], int).reshape(-1, 2).T
        m = np.array([v for x in left.tolist() for v in out[x].values()], float).reshape(-1, 3).T
    p, place = np.zeros((len(left), len(left))), np.full(n, -1)
    place[left] = np.arange(len(left))
    p[place[s], place[d]] = m[0]
    sides = {side: left == x for side, x in zip("AB", net.ab)}
    got = reduce._committor(left, p, np.bincount(place[s], m[1], len(left)), sides)
    q, t = np.zeros(n), np.zeros(n)
    q[left], t[left] = got["committor"], got["mfpt_to_b"]
    for x, loop, row in reversed(steps):
        go = sum(v[0] for v in row.values())
        q[x] = sum(v[0] * q[y] for y, v in row.items()) / go
        t[x] = (sum(v[0] * t[y] + v[1] for y, v in row.items()) + loop[1]) / go
    return pd.DataFrame({"node": net.names[net.core], "committor": q, "mfpt_to_b": t})


def _lengths(s: np.ndarray, d: np.ndarray, w: np.ndarray, ab: np.ndarray) -> dict:
    """Of each side, the states that can be reached from it and their distances."""
    far = graph._shortest_of(pd.DataFrame({"src": s, "dst": d, "w": w}), pd.DataFrame({NET: "", "side": list("AB"), "node": ab}))
    return {side: dict(zip(x["node"], x["dist"])) for side, x in far.groupby("side")}


def graph_features(net: Net, groups: tuple[str, ...]):
    """``features.feature_row`` of the reduced network, but for its name: A and B are one state each."""
    s, d, m = net.reduced
    nodes, tau = np.unique(s), np.bincount(s, m[1], len(net.core))
    off = s != d
    s, d, p = s[off], d[off], m[0][off]
    k = p / tau[s]
    ab, out = net.ab, {}
    if not len(s):
        raise Joined
    pair = np.unique(np.r_[s * len(net.core) + d, d * len(net.core) + s])
    x, y = pair // len(net.core), pair % len(net.core)  # both ways
    length = lambda v: (lambda w: w - min(0.0, w.min()))(-np.log(np.maximum(v, 1e-300)))
    branch, rate, hops = (_lengths(*e, ab) for e in ((s, d, length(p)), (s, d, length(k)), (x, y, np.ones(len(x)))))

    def distance():
        r = {}
        for name, far in (("branch", branch), ("rate", rate)):
            go, come = far["A"].get(ab[1]), far["B"].get(ab[0])
            r |= {f"{name}_dist_ab_min": go, f"{name}_dist_ab_mean": go, f"{name}_dist_ba_min": come, f"{name}_dist_ba_mean": come, f"{name}_dist_asymmetry": None if go is None or come is None else abs(go - come)}
        return r

    def spectral():
        return {f"spectral_{c}": v for c, v in spectral_features(net).items()}

    def centrality():
        w = np.where(np.isin(np.arange(len(tau)), nodes), net.pi * tau / net.tau, 0)
        pi = (w / w.sum())[ab]
        pr = graph._pagerank_of(200, 0.85, 1e-8)(pd.DataFrame({NET: "", "node": nodes}), pd.DataFrame({"src": s, "dst": d, "k": k}))
        ev = graph._dominant(1000, 1e-10)(pd.DataFrame({NET: "", "src": np.r_[x, nodes], "dst": np.r_[y, nodes]}))
        if ev["change"].sum() >= 1e-10:
            raise ValueError("eigenvector centrality has not settled to 1e-10 in 1000 rounds")
        r = {"pi_a": pi[0], "pi_b": pi[1], "pi_ratio_ab": pi[0] / max(pi[1], 1e-300)}
        for name, v in (("pagerank", pr), ("eigvec_centrality", ev)):
            r |= {f"{name}_{side}": v["r"].to_numpy()[np.searchsorted(v["node"], a)] for side, a in zip("ab", ab)}
        return r | {f"closeness_centrality_{side.lower()}": (len(far) - 1) / sum(far.values()) if len(far) > 1 else 0.0 for side, far in hops.items()}

    def path():
        n = hops["A"].get(ab[1])
        return {} if n is None else {"shortest_path_hops_ab": n, "rate_shortest_path_ab": rate["A"].get(ab[1]), "n_short_pairs_ab": 1, "path_redundancy": 1.0}

    def topology():
        n, deg = len(nodes), np.bincount(x, minlength=len(net.core))
        at, a, b = deg[nodes].astype(float), deg[x].astype(float), deg[y].astype(float)
        std, spread = at.std(), a.std() * b.std()
        root = graph.roots(n, np.searchsorted(nodes, s), np.searchsorted(nodes, d))
        t = graph._triangles_of(pd.DataFrame({NET: "", "src": x, "dst": y}))
        three = np.bincount(t["node"], t["triangles"], len(net.core))[nodes]
        cluster = np.where(at > 1, 2 * three / np.maximum(at * (at - 1), 1), 0)
        return {
            "n_nodes": n, "n_edges_directed": len(s), "n_edges_undirected": len(x) // 2, "density": len(x) / (n * (n - 1)) if n > 1 else None, "degree_mean": at.mean(), "degree_std": std, "degree_max": int(at.max()), "degree_min": int(at.min()), "degree_skew": ((at - at.mean()) ** 3).mean() / std**3 if std > 0 else 0.0,
            "degree_assortativity": ((a - a.mean()) * (b - b.mean())).mean() / spread if spread > 0 else 0.0, "n_components": len(np.unique(root)), "largest_component_frac": np.bincount(root).max() / n, "clustering_coeff_mean": cluster.mean(), "clustering_coeff_std": cluster.std(),
        }

    made = {"distance": distance, "spectral": spectral, "centrality": centrality, "community": lambda: spectral_communities(net) or {}, "path": path, "topology": topology}
    gaps = []
    for g in groups:
        if g in made:
            r = made[g]()
            gaps += [g] * all(v is None for v in r.values())
            out |= r
    return out | {"status": f"PARTIAL({'; '.join(gaps)})" if gaps else "OK"}


def robustness_grid(net: Net, cuts: list[float], window: float = 1.0):
    """Each model is made from the one of the cut before: the states of a higher cut are among those of a lower one, and
    removing states leaves the same model in any order. So the last step, down to A and B, gives the passage times of all."""
    n, e = len(net.core), net.energy[net.core]
    on = net.place[net.f] >= 0
    f, i = net.place[net.f[on]], net.place[net.i[on]]
    barrier = np.maximum(0.0, net.e_ts[on] - np.minimum(e[f], e[i]))
    extra = e - e.min() <= window
    extra[net.ab] = True
    rows, model, was = [], None, np.ones(n, bool)
    for cut in sorted(cuts):
        root = graph.roots(n, f[barrier <= cut], i[barrier <= cut])
        kept = extra.copy()
        kept[net.low[np.unique(root[net.low], return_index=True)[1]]] = True
        assert not (kept & ~was).any()
        if (kept != was).any() or model is None:
            model, was = net.reduce(kept, model), kept
        t = -1 / modes(net, model, 5)
        rows.append({"cut": float(cut), "n_eff": len(np.unique(model[0]))} | {f"t_relax_{j + 1}": v for j, v in enumerate(t)})
    way = net.passage(model)
    return [r | {c: way.get(c) for c in ("mfpt_ab", "mfpt_ba")} for r in rows]


def runner(task, columns: list[str], edges: bool = True):
    """task(net) as a function of a network's minima and transition states; without edges there is no row unless ``edges`` is False. It gives a row, a list or a frame of them."""

    def run(minima: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if not len(minima):
            rows, name, joined = [], None, False
        else:
            name, joined = minima[NET].iloc[0], False
            try:
                net = Net(minima.drop(columns=NET), ts[["f", "i", "e_ts", "s_ts"]])
                rows = None if net.empty and edges else task(net)
            except Joined:
                rows, joined = {}, True
            if isinstance(rows, pd.DataFrame):
                return rows.reindex(columns=columns).assign(**{NET: name, "joined": False})[[NET, *columns, "joined"]]
            rows = rows if isinstance(rows, list) else [] if rows is None else [rows]
        return pd.DataFrame({NET: pd.Series([name] * len(rows), dtype=object), **{c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns}, "joined": pd.Series([joined] * len(rows), dtype=bool)})

    return run
