"""Networks that one task takes give what joins and plain elimination give."""

import numpy as np
import pytest

from ctmcflow.operators import reduce
from ctmcflow.session import Scratch


def jumps(n: int, seed: int, degree: int = 4):
    """A connected random chain of n states: (src, dst, moments[3, ..])."""
    rng = np.random.default_rng(seed)
    pair = {(i, int(rng.integers(i))) for i in range(1, n)} | {(int(a), int(b)) for a, b in rng.integers(n, size=(n * degree // 2, 2)) if a != b}
    s, d = np.array(sorted({p for a, b in pair for p in ((a, b), (b, a))})).T
    k = np.exp(rng.uniform(-6, 0, len(s)))
    escape = np.bincount(s, k, n)
    p, tau = k / escape[s], 1 / escape[s]
    return s, d, np.array([p, p * tau, 2 * p * tau * tau])


def plain(m: np.ndarray, kept: int) -> np.ndarray:
    """State by state, with the moments as a truncated series."""
    for x in range(m.shape[1] - 1, kept - 1, -1):
        h = reduce._loops(m[0, x, :x].sum(), m[:, x, x].copy())
        i, o = reduce._times(tuple(m[:, :x, x]), h), m[:, x, :x]
        m[0, :x, :x], m[1, :x, :x], m[2, :x, :x] = (m[k, :x, :x] + v for k, v in enumerate((np.outer(i[0], o[0]), np.outer(i[1], o[0]) + np.outer(i[0], o[1]), np.outer(i[2], o[0]) + 2 * np.outer(i[1], o[1]) + np.outer(i[0], o[2]))))
    return m[:, :kept, :kept]


@pytest.mark.parametrize("n, kept", [(60, 2), (300, 40), (150, 149)])
def test_reduction_in_blocks_is_plain_elimination(n, kept):
    s, d, v = jumps(n, n)
    m = np.zeros((3, n, n))
    m[:, s, d] = v
    want = plain(m.copy(), kept)
    assert np.allclose(reduce.eliminate(m.copy(), kept), want, rtol=1e-10, atol=0)
    x, y, got = reduce.reduce_one(n, s, d, v, np.arange(n) < kept)
    full = np.zeros_like(want)
    full[:, x, y] = got
    assert np.allclose(full, want, rtol=1e-10, atol=0)


def test_network_beyond_the_old_matrix_takes_no_join_round(spark, monkeypatch):
    n = 1500
    s, d, v = jumps(n, 5)
    edges = spark.createDataFrame([("x", int(a), int(b), *map(float, c)) for a, b, c in zip(s, d, v.T)], reduce.EDGES)
    ab = spark.createDataFrame([("x", 0, "A"), ("x", 1, "B")], "network_id string, min_id long, side string")

    def never(*_):
        raise AssertionError("a round of joins")

    monkeypatch.setattr(reduce, "remove_round", never)
    r = reduce.passage(Scratch(spark, "one"), edges, ab).collect()[0]
    p, tau = np.zeros((n, n)), np.bincount(s, v[1], n)
    p[s, d] = v[0]
    rest = np.arange(n) != 1
    assert np.isclose(r["mfpt_ab"], np.linalg.solve((np.eye(n) - p)[np.ix_(rest, rest)], tau[rest])[0], rtol=1e-8)
