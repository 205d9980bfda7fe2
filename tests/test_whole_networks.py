"""Queries and operators that must cover whole networks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_networks import dense, frames, passage, random_network

from ctmcflow.operators import ctmc, reduce
from ctmcflow.plans import networks
from ctmcflow.session import Scratch

SF = "/root/testdata/sf0.001"


def generators(rates):
    """(states, rates as a matrix) of each network's largest component."""
    by = {}
    for r in rates.collect():
        by.setdefault(r["network_id"], {})[r["src"], r["dst"]] = r["k"]
    return {n: (names := sorted({s for s, _ in e}), np.array([[e.get((a, b), 0.0) for b in names] for a in names])) for n, e in by.items()}


@pytest.fixture(scope="module")
def whole(spark):
    k = networks.Ktn(spark, SF, "whole")
    _, r, ab = k.connected()
    return generators(r), {(x["network_id"], x["side"]): x["min_id"] for x in ab.collect()}


def test_spectrum_and_committor_cover_all_states(spark, whole):
    nets, sides = whole
    modes = networks.spectrum(spark, SF).collect()
    got = {(r["network_id"], r["node"]): r for r in networks.committor_mfpt(spark, SF).collect()}
    assert set(got) == {(n, x) for n, (names, _) in nets.items() for x in names}
    for n, (names, k) in nets.items():
        ev = np.sort(np.linalg.eigvals(k - np.diag(k.sum(1))).real)[::-1]
        assert [r["lambda"] for r in sorted(modes, key=lambda r: r["mode"]) if r["network_id"] == n] == pytest.approx(list(ev[ev < -1e-12][:10]), rel=1e-6, abs=1e-11)
        a, b = names.index(sides[n, "A"]), names.index(sides[n, "B"])
        assert got[n, names[a]]["mfpt_to_b"] == pytest.approx(passage(k, a, b)[0], rel=1e-6)


def test_reduced_networks_follow_the_hybrid_rule(spark, whole):
    nets, _ = whole
    got = {r["network_id"]: r["n"] for r in networks.gt_reduce(spark, SF).groupBy("network_id").agg(F.count("*").alias("n")).collect()}
    assert all(got[n] >= min(50, len(names)) for n, (names, _) in nets.items())


def test_large_networks_need_no_dense_matrix(spark):
    minima, ts = frames(spark, {"x": random_network(300, 7), "y": random_network(30, 8)})
    rates = ctmc.tst_rates(ts, minima).cache()
    micro = reduce.jump_moments(ctmc.branching(rates).select("network_id", "src", "dst", "b"), ctmc.waiting_times(rates)).cache()
    ab = ctmc.part_ab(minima)
    modes = {(r["network_id"], r["mode"]): r["lambda"] for r in reduce.spectrum(micro, dense=20).collect()}
    small = {(r["network_id"], r["node"]): r for r in reduce.committor_all(Scratch(spark, "ca"), micro, ab, dense=200).collect()}
    large = {(r["network_id"], r["node"]): r for r in reduce.committor_mfpt(micro, ab).collect()}
    assert set(small) == set(large) and len(large) == 330
    for x, r in large.items():
        assert small[x]["committor"] == pytest.approx(r["committor"], rel=1e-9) and small[x]["mfpt_to_b"] == pytest.approx(r["mfpt_to_b"], rel=1e-9)
    for name, n in (("x", 300), ("y", 30)):
        k = dense(rates, name, n)
        ev = np.sort(np.linalg.eigvals(k - np.diag(k.sum(1))).real)[::-1][1:11]
        assert [modes[name, i] for i in range(1, 11)] == pytest.approx(list(ev), rel=1e-6)
