"""Loops that must run until they have settled, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_networks import dense, frames, random_network

from ctmcflow.operators import ctmc, graph
from ctmcflow.session import Scratch


def test_centralities_settle(spark):
    minima, ts = frames(spark, {"x": random_network(40, 11)})
    rates = ctmc.tst_rates(ts, minima).cache()
    nodes = minima.select("network_id", F.col("min_id").alias("node"))
    k = dense(rates, "x", 40)
    p = k / k.sum(1, keepdims=True)
    want = np.linalg.solve(np.eye(40) - 0.85 * p.T, np.full(40, 0.15 / 40))
    got = np.array([r["r"] for r in graph.pagerank(Scratch(spark, "pr"), nodes, rates, 200, tol=1e-8).orderBy("node").collect()])
    assert np.abs(got - want / want.sum()).sum() < 1e-7
    vec = np.abs(np.linalg.eigh(((k + k.T) > 0).astype(float))[1][:, -1])
    got = np.array([r["r"] for r in graph.eigenvector_centrality(Scratch(spark, "ev"), nodes, rates, 400, tol=1e-8).orderBy("node").collect()])
    assert np.abs(got - vec / vec.sum()).sum() < 1e-6
    with pytest.raises(ValueError):
        graph.eigenvector_centrality(Scratch(spark, "ev2"), nodes, rates, 2, tol=1e-12)
