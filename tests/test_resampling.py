"""Replicates of the resampling queries: as many as the reference takes, whatever the blocks."""

import numpy as np
import pytest

from ctmcflow.operators import stats
from ctmcflow.plans import reports

SF = "/root/testdata/sf0.001"


def test_replicates_are_the_references(spark, monkeypatch):
    assert reports.perm_test(spark, SF).first()["times"] == 1000
    assert reports.bootstrap_ci(spark, SF).first()["n_boot"] == 2000
    asked, real = [], stats.shuffled
    monkeypatch.setattr(stats, "shuffled", lambda i, n, times, *a, **k: asked.append(times) or real(i, n, times, *a, **k))
    assert reports.perm_importance(spark, SF).count() == 3 and asked == [50, 50, 50]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i + 1, float(a), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))], "id long, rn long, a double, y double").cache()
    got = []
    for block in (7, 100):
        monkeypatch.setattr(stats, "BLOCK", block)
        got.append((stats.permutation_test(df, ["a"], "y", 20), tuple(stats.bootstrap(df, ["a"], "y", "id", 20).first())))
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])
