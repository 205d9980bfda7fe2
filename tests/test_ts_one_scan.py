"""Transition states of parts that share orders: one scan and one sort of the lines, pairs as by a self-join."""

from ctmcflow.operators import ctmc
from ctmcflow.session import Scratch


def test_pairs_without_self_join(spark):
    sf = Scratch(spark, "ts").root
    parts = [(k, "x" if k < 6 else "y", 900.0 + 10 * k, 5) for k in range(9)] + [(9, None, 950.0, 5)]
    lines = [(1, k) for k in (0, 1, 1, 2, 7, 9)] + [(2, 3), (2, 3), (3, 6), (3, 8), (3, 5), (None, 0), (None, 1), (4, None), (5, 99), (5, 0)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double, p_size int").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{sf}/lineitem.parquet")
    t = ctmc.part_ts(spark, sf)
    got = sorted((r["network_id"], r["ts_order"], r["f"], r["i"], round(r["e_ts"], 6), round(r["s_ts"], 6)) for r in t.collect())
    assert got == [("x", 1, 0, 1, 1.5, 0.02), ("x", 1, 0, 2, 2.5, 0.02), ("x", 1, 1, 2, 2.5, 0.02), ("y", 3, 6, 8, 9.0, 0.06)]
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1, plan  # lines with parts, not with lines
