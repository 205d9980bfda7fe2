"""Loops of networks that one task takes against the same loops by joins."""

from pyspark.sql import functions as F

from ctmcflow.operators import graph
from ctmcflow.session import Scratch


def two(spark):
    """A ring with chords and a star with a tail beside an isolated node; rates differ both ways."""
    e = [("a", i, (i + k) % 30) for i in range(30) for k in (1, 2, 7, 11)] + [("b", 0, i) for i in range(1, 9)] + [("b", 8, 9)]
    rows = [(n, x, y, 1.0 + (3 * x + 5 * y) % 7) for n, u, v in e for x, y in ((u, v), (v, u))]
    nodes = [("a", i) for i in range(30)] + [("b", i) for i in range(11)]
    return spark.createDataFrame(nodes, "network_id string, node long").cache(), spark.createDataFrame(rows, "network_id string, src long, dst long, k double").cache()


def same(one, other, keys, value):
    x, y = ({tuple(r[k] for k in keys): r[value] for r in df.collect()} for df in (one, other))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-8 for k in x)


def test_eigenvector_takes_one_task(spark, monkeypatch):
    nodes, rates = two(spark)
    nodes = nodes.filter("NOT (network_id = 'b' AND node = 10)")
    run = lambda **x: graph.eigenvector_centrality(Scratch(spark, "ot"), nodes, rates, 400, tol=1e-11, **x)
    joined, mixed = run(most=0), run(most=60)
    monkeypatch.setattr(graph, "_powers", None)  # a step by joins fails
    same(run(), joined, ("network_id", "node"), "r")
    same(mixed, joined, ("network_id", "node"), "r")


def test_pagerank_and_paths_in_one_task(spark):
    nodes, rates = two(spark)
    run = lambda **x: graph.pagerank(Scratch(spark, "ot"), nodes, rates, 200, tol=1e-10, **x)
    same(run(), run(most=0), ("network_id", "node"), "r")
    same(run(most=60), run(most=0), ("network_id", "node"), "r")
    sources = spark.createDataFrame([("a", "A", 0), ("a", "A", 3), ("a", "B", 17), ("b", "A", 9), ("b", "B", 10)], "network_id string, side string, node long")
    way = lambda w, **x: graph.shortest(Scratch(spark, "ot"), rates, sources, w, **x)
    for w in (None, "k"):
        same(way(w), way(w, most=0), ("network_id", "side", "node"), "dist")
        same(way(w, most=60), way(w, most=0), ("network_id", "side", "node"), "dist")


def test_triangles_of_a_matrix(spark):
    nodes, rates = two(spark)
    for c in ("triangles", "clustering"):
        same(graph.triangles(nodes, rates), graph.triangles(nodes, rates, most=0), ("network_id", "node"), c)
    assert graph.triangles(nodes, rates).agg(F.sum("triangles")).collect()[0][0] > 0
