"""Queries that take a network through one task: few written tables, and the rows that the joins give."""

import math

import pytest

from ctmcflow import session
from ctmcflow.operators import single
from ctmcflow.plans import features, networks

SF = "/root/testdata/sf0.001"
NAMES = ["eigengap", "gt_stationary", "spectral_communities", "ab_set_kinetics", "gt_validate", "micro_report_built", "spectral_features", "robustness_grid"]
NOISE = {"rel_pi_eff", "max_abs_colsum", "qpi_norm1", "qpi_rel", "relerr_ab", "relerr_ba", "log10_ratio_ab"}  # rounding errors themselves


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["network_id"], r.get("cut") or 0))


def same(got, want):
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert list(g) == list(w)
        for c, v in w.items():
            if isinstance(v, float):
                assert math.isclose(g[c], v, rel_tol=1e-6, abs_tol=1e-9 if c in NOISE else 1e-15), (c, g, w)
            else:
                assert g[c] == v, (c, g, w)


@pytest.mark.parametrize("name", NAMES)
def test_one_task_gives_what_joins_give(spark, monkeypatch, name):
    query = {**networks.QUERIES, **features.QUERIES}[name]
    made, put = [], session.Scratch.put
    monkeypatch.setattr(session.Scratch, "put", lambda self, df, name, keep=0: made.append(name) or put(self, df, name, keep))
    got = rows(query(spark, SF))
    assert set(made) <= {"minima", "ts", "each"}, made
    monkeypatch.setattr(single, "MOST_TS", -1)
    want = rows(query(spark, SF))
    assert len(made) > 4
    same(got, want)


def test_gaps_go_through_joins(spark, monkeypatch):
    k = networks.Ktn(spark, SF, "gaps").only([networks.Ktn(spark, SF, "x").minima.first()["network_id"]])
    m = k.minima
    k._kept["minima"] = m.unionByName(m.limit(1).selectExpr("network_id", "-1L AS min_id", "CAST(NULL AS DOUBLE) AS energy", "log_prod"))
    asked = []
    made = k.each(single.gt_stationary, "n_eff long, rel_pi_restricted double, rel_pi_eff double", lambda only: asked.append(only.minima.count()) or features._stationary(networks.Ktn(spark, SF, "y").only(["none"])))
    assert made.count() == 0 and asked == [m.count() + 1]
