"""The reference's combined rule: one percentile of tau * pi."""

import numpy as np

from ctmcflow.operators import ctmc
from ctmcflow.plans import networks


def test_product_rule(spark):
    assert "keep_product" in networks.QUERIES
    rng = np.random.default_rng(6)
    pi, tau = rng.random(400), rng.lognormal(0, 2, 400)
    s = spark.createDataFrame([("x", i, float(a), float(b), i < 2) for i, (a, b) in enumerate(zip(pi, tau))], "network_id string, node long, pi double, tau double, must boolean")
    got = {r["node"] for r in ctmc.keep_states(s, ctmc.PRODUCT, 5.0, 2).filter("kept").collect()}
    metric = (tau * pi)[2:]
    assert got == {0, 1} | {2 + int(i) for i in np.flatnonzero(metric >= np.percentile(metric, 95))}
    either = {r["node"] for r in ctmc.keep_states(s, "combined", 5.0, 2).filter("kept").collect()}
    assert len(either) < len(got)
