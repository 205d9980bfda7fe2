"""Slow modes of sparse networks by a sparse factor, without a large matrix and without many steps."""

import numpy as np
from test_one_task import jumps

from ctmcflow.operators import reduce


def test_sparse_factor_gives_the_modes_of_the_matrix(monkeypatch):
    n, k = 600, 6
    s, d, v = jumps(n, 3)
    pi = np.exp(np.random.default_rng(1).uniform(-6, 0, n))
    w = np.minimum(pi[s], pi[d])
    rate = w / pi[s]
    escape = np.bincount(s, rate, n)
    m = np.diag(escape)
    m[s, d] -= w / np.sqrt(pi[s] * pi[d])
    want = -np.linalg.eigvalsh(m)[1 : k + 1]
    p, tau = rate / escape[s], 1 / escape[s]

    def never(*_, **__):
        raise AssertionError("many steps")

    with monkeypatch.context() as x:
        x.setattr(reduce, "slow_modes", never)
        assert np.allclose(reduce.slowest(n, s, d, p, p * tau, k, dense=100), want, rtol=1e-9)
    assert reduce.sparse_solver(n, s, d, w, escape + 1, most=3, core=10) is None
    monkeypatch.setattr(reduce, "sparse_solver", lambda *_: None)  # too large a matrix: steps on the edges
    assert np.allclose(reduce.slowest(n, s, d, p, p * tau, k, dense=100), want, rtol=1e-9)
