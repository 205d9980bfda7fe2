"""Components of networks that one task takes against those by joins."""

from ctmcflow.operators import graph
from ctmcflow.session import Scratch


def labels(df):
    return sorted(((r["network_id"], r["node"], r["comp"]) for r in df.collect()), key=str)


def test_components_in_one_task(spark, monkeypatch):
    edges = [("a", i + 1, i) for i in range(90)] + [("a", 200, 201), ("b", 5, 9), ("b", 9, 5), ("b", 7, 7), ("b", 3, 99), (None, 1, 2)]
    nodes = [("a", i) for i in (*range(91), 200, 201, 300)] + [("b", i) for i in (3, 5, 7, 9)] + [(None, 1), (None, 2), ("b", None)]
    nodes = spark.createDataFrame(nodes, "network_id string, node long")
    edges = spark.createDataFrame(edges, "network_id string, src long, dst long")
    run = lambda **x: labels(graph.components(Scratch(spark, "cc"), nodes, edges, **x))
    joined, mixed = run(most=0), run(most=50)
    monkeypatch.setattr(graph, "_components_joined", None)  # a round by joins fails
    assert run() == joined == mixed
    assert ("a", 90, 0) in joined and ("a", 201, 200) in joined and ("b", 9, 5) in joined and ("b", None, None) in joined
