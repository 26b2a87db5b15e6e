"""Singular values and vectors against numpy's, with clusters, zeros and equal values."""
import numpy as np
import pytest

from tabsense.llm.qd import bidiagonal, right_vectors

RNG = np.random.default_rng(5)
TURN = np.linalg.qr(RNG.standard_normal((20, 20)))[0]
CASES = {
    "random": RNG.standard_normal((20, 20)),
    "graded": RNG.standard_normal((20, 20)) * 10.0 ** np.linspace(0, -9, 20),
    "low rank": RNG.standard_normal((20, 2)) @ RNG.standard_normal((2, 20)),
    "zeros": np.zeros((20, 20)),
    "identity": np.eye(20),
    "equal": TURN * 3.0,
    "cluster": TURN * np.array([2, 2 * (1 + 1e-13), 2 * (1 - 1e-9)] + [1] * 17) @ TURN.T,
    "diagonal": np.diag(np.arange(20.0)),
    "one column": np.array([[4.0]]),
    "two columns": np.array([[3.0, 1.0], [0.0, 0.0]]),
}


@pytest.mark.parametrize("name", CASES)
def test_values_and_vectors(name):
    r = np.linalg.qr(CASES[name], mode="r")
    values, z = right_vectors(r, min(8, len(r)))
    want = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-10
    assert np.abs(r.T @ r @ z - z * values[:z.shape[1]]).max() <= 1e-13 * top
    assert (z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])] > 0).all()


def test_bidiagonal_keeps_the_values():
    a, b, v = bidiagonal(CASES["random"])
    got = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
    assert np.allclose(got, np.linalg.svd(CASES["random"], compute_uv=False), rtol=1e-12)
    assert np.allclose(v.T @ v, np.eye(20))
