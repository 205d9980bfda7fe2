"""Further queries that take a network through one task: few written tables, and the rows that the joins give."""

import math

import numpy as np
import pandas as pd
import pytest

from ctmcflow import session
from ctmcflow.operators import reduce, single
from ctmcflow.plans import features, networks

SF = "/root/testdata/sf0.001"
NAMES = ["ab_kinetics", "gt_reduce", "spectrum", "committor_mfpt", "graph_features", "graph_features_lite"]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["network_id"], r.get("node") or 0, r.get("mode") or 0))


@pytest.mark.parametrize("name", NAMES)
def test_one_task_gives_what_joins_give(spark, monkeypatch, name):
    query = {**networks.QUERIES, **features.QUERIES}[name]
    made, put = [], session.Scratch.put
    monkeypatch.setattr(session.Scratch, "put", lambda self, df, name, keep=0: made.append(name) or put(self, df, name, keep))
    got = query(spark, SF)
    kinds, got = got.dtypes, rows(got)
    assert set(made) <= {"minima", "ts", "each"}, made
    monkeypatch.setattr(single, "MOST_TS", -1)
    want = query(spark, SF)
    assert kinds == want.dtypes
    want = rows(want)
    assert len(made) > 4 and len(got) == len(want) > 0
    for g, w in zip(got, want):
        for c, v in w.items():
            if isinstance(v, float):
                assert math.isclose(g[c], v, rel_tol=1e-6, abs_tol=1e-12), (c, g, w)
            else:
                assert g[c] == v, (c, g, w)


def chain(n: int) -> single.Net:
    """A ring with some chords."""
    rng = np.random.default_rng(1)
    minima = pd.DataFrame({"min_id": range(n), "energy": rng.uniform(0, 5, n), "log_prod": rng.uniform(0, 1, n)})
    f, i = np.r_[np.arange(n), rng.integers(n, size=n)], np.r_[(np.arange(n) + 1) % n, rng.integers(n, size=n)]
    return single.Net(minima, pd.DataFrame({"f": f, "i": i, "e_ts": 6.0 + rng.uniform(0, 2, 2 * n), "s_ts": 0.1}))


@pytest.mark.parametrize("most, dense", [(60, 2), (4, 55)])
def test_states_removed_first_get_their_values_back(monkeypatch, most, dense):
    monkeypatch.setattr(reduce.remove_sparse, "__defaults__", (most, None))
    want, got = (single.committor_mfpt(chain(60), dense=n) for n in (60, dense))
    assert got["node"].tolist() == want["node"].tolist() == list(range(60))
    for c in ("committor", "mfpt_to_b"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12)


def test_more_states_than_one_task_takes_are_left_to_the_joins(monkeypatch):
    net = chain(60)
    monkeypatch.setattr(reduce, "LOCAL", 57)
    with pytest.raises(single.Joined):
        single.committor_mfpt(net, dense=59)
    assert len(single.committor_mfpt(net, dense=60)) == 60
