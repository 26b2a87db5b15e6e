"""Singular values and right singular vectors of a small square matrix: Householder
bidiagonal form, differential quotient-difference steps with shifts (dqds), twisted
factorisations.  Plain numpy; the matrix is the d x d factor of a blockwise QR."""
from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: An off-diagonal square this small beside its diagonal leaves the values as they are.
NEGLIGIBLE = (4 * EPS) ** 2
#: Values nearer to each other than this share (of the larger) have their vectors made orthogonal.
CLUSTER_GAP = 0.1


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, t and r with (I - t v v') x = r e1; nothing to do when the rest of x is zero."""
    norm = np.linalg.norm(x)
    if norm == 0 or not x[1:].any():
        return x, 0.0, x[0]
    r = -np.copysign(norm, x[0])
    v = x.copy()
    v[0] -= r
    v /= np.abs(v).max()
    return v, 2.0 / (v @ v), r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): U' r v is upper bidiagonal with diagonal ``a`` and superdiagonal ``b``."""
    m, d = r.copy(), r.shape[1]
    v = np.eye(d)
    for k in range(d):
        h, t, m[k, k] = _reflector(m[k:, k].copy())
        if t:
            m[k:, k + 1:] -= t * np.outer(h, h @ m[k:, k + 1:])
        if k + 1 < d:
            h, t, m[k, k + 1] = _reflector(m[k, k + 1:].copy())
            if t:
                m[k + 1:, k + 1:] -= t * np.outer(m[k + 1:, k + 1:] @ h, h)
                v[:, k + 1:] -= t * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A shift below the least value: an unshifted step's d_i are the inverse diagonal of
    the inverse, whose trace is at least the inverse of the least value."""
    d, total = q[0], 1.0 / q[0]
    for i, off in enumerate(e):
        d = d * (q[i + 1] / (d + off))
        if d <= 0:
            return 0.0
        total += 1.0 / d
    return (1.0 / total) * (1 - 8 * len(q) * EPS)


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift was too large."""
    d, new_q, new_e = q[0] - shift, [], []
    for i, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        if top == 0:
            return None
        t = q[i + 1] / top
        new_q.append(top)
        new_e.append(off * t)
        d = d * t - shift
    return None if d < 0 else (new_q + [d], new_e)


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal (a, b), falling, by dqds."""
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top == 0:
        return np.zeros(len(a))
    least = EPS * 1e-3                       # a zero diagonal entry becomes one far below rounding
    q = [max(abs(x) / top, least) ** 2 for x in a]
    e = [(x / top) ** 2 for x in b]
    found, open_parts = [], [(q, e, 0.0)]
    while open_parts:
        q, e, base = open_parts.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= NEGLIGIBLE * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                open_parts.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:           # the least values belong at the end
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e)
            while (after := _step(q, e, shift)) is None:
                if shift == 0:               # a zero inside: raise it by less than rounding
                    q = [max(x, (EPS * least) ** 2) for x in q]
                shift = shift / 2 if shift > EPS ** 2 * base else 0.0
            (q, e), base = after, base + shift
        found += [base + x for x in q]
    return np.sort(np.array(found))[::-1] * top ** 2


def _pivot(x: float, tiny: float) -> float:
    return x if abs(x) > tiny else (-tiny if x < 0 else tiny)


def _twisted(diag, low, value, tiny):
    """Stationary and progressive factors of L D L' - value, and the twist's remainders."""
    n = len(diag)
    down, s = np.zeros(n), np.empty(n)
    pivots = np.empty(n)
    s[0] = -value
    for i in range(n):
        pivots[i] = _pivot(diag[i] + s[i], tiny)
        if i + 1 < n:
            down[i] = diag[i] * low[i] / pivots[i]
            s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(n), np.empty(n)
    p[-1] = diag[-1] - value
    for i in range(n - 2, -1, -1):
        below = _pivot(diag[i] * low[i] ** 2 + p[i + 1], tiny)
        up[i] = low[i] * (diag[i] / below)
        p[i] = p[i + 1] * (diag[i] / below) - value
    return down, pivots, up, np.abs(s + p + value)


def _twist_vector(down, up, at):
    z = np.zeros(len(down))
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at + 1, len(z)):
        z[i] = -up[i - 1] * z[i - 1]
    return z / np.linalg.norm(z)


def _clear(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def _solve(down, pivots, z):
    """The factorised matrix's inverse times ``z`` (its growth is what is wanted)."""
    z = z.copy()
    for i in range(1, len(z)):
        z[i] -= down[i - 1] * z[i - 1]
    z /= pivots
    for i in range(len(z) - 2, -1, -1):
        z[i] -= down[i] * z[i + 1]
    return z


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors of (a, b) for the ``count`` largest of ``values``, as columns."""
    d = len(a)
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top == 0:
        return np.eye(d)[:, :count]
    a = np.where(np.abs(a) < top * EPS * 1e-3, top * EPS * 1e-3, a) / top
    diag, low = a * a, (b / top) / a[:-1]
    tiny, out, scaled = (EPS * 1e-3) ** 2, [], values / top ** 2
    rng = np.random.default_rng(3)
    for k in range(count):
        near = [out[j] for j in range(k) if abs(scaled[j] - scaled[k]) <= CLUSTER_GAP * scaled[j] + 4 * EPS]
        down, pivots, up, rest = _twisted(diag, low, scaled[k], tiny)
        z = _clear(_twist_vector(down, up, int(rest.argmin())), near)
        while np.linalg.norm(z) < 0.5:       # another vector of the same value
            z = _clear(rng.standard_normal(d), out)
            for _ in range(3):
                z = _clear(_solve(down, pivots, z / np.linalg.norm(z)), near)
                z = z / np.abs(z).max()
            z = _clear(z / np.linalg.norm(z), near)
        out.append(z / np.linalg.norm(z))
    return np.array(out).T


def right_vectors(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of ``r``, falling, and the first ``count`` right vectors
    as columns; of either sign the one whose largest entry is positive."""
    a, b, v = bidiagonal(r)
    values = squared_values(a, b)
    z = v @ vectors(a, b, values, count)
    z = z / np.linalg.norm(z, axis=0)
    signs = np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return values, z * np.where(signs == 0, 1, signs)
