"""Singular values and right singular vectors of a small square matrix by qd methods.

Householder reflections make the matrix bidiagonal, differential quotient-
difference steps with shifts find all squared singular values to high relative
accuracy, and a twisted factorisation at each of them gives its vector. Used
on the triangular factor of a distributed QR, so sizes are those of one vector.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
# Neighbours closer than this share of the larger are orthogonalised together.
CLOSE = 1e-6


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and a so that (1 - 2 v v') x = a e1."""
    size = float(np.linalg.norm(x))
    if size == 0.0:
        return np.zeros_like(x), 0.0
    a = -math.copysign(size, x[0])
    v = x.copy()
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor P with r = Q B P'."""
    a = np.array(r, float)
    n = a.shape[1]
    right = np.eye(n)
    for i in range(n):
        v, _ = _reflector(a[i:, i])
        a[i:, i:] -= 2.0 * np.outer(v, v @ a[i:, i:])
        if i < n - 2:
            v, _ = _reflector(a[i, i + 1 :])
            a[i:, i + 1 :] -= 2.0 * np.outer(a[i:, i + 1 :] @ v, v)
            right[:, i + 1 :] -= 2.0 * np.outer(right[:, i + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step; also the running differences, negative if the shift was too large."""
    out_q, out_e, seen = [], [], []
    d = q[0] - shift
    for i in range(len(e)):
        seen.append(d)
        new = d + e[i]
        ratio = q[i + 1] / new if new else math.inf
        out_q.append(new)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
    seen.append(d)
    out_q.append(d)
    return out_q, out_e, seen


def squared_singular_values(q, e) -> list[float]:
    """Squares of the singular values of an unreduced bidiagonal, falling; q and e hold squared entries.

    The differences of a step without shift are the reciprocals of the
    diagonal of the inverse, so one over the sum of their reciprocals is a
    safe shift: never above the smallest value, and close to it once that
    value has come apart from the others.
    """
    q, e, total, found = list(q), list(e), 0.0, []
    while len(q) > 1:
        if e[-1] <= (EPS * EPS) * q[-1] or e[-1] <= EPS * EPS * (total + q[-1]):
            found.append(total + q.pop())
            e.pop()
            continue
        probe = _step(q, e, 0.0)
        smallest = min(probe[2])
        if smallest <= 0.0:  # a value that rounds to zero: the unshifted step moves it to the end
            q, e, _ = probe
            q[-1] = max(q[-1], 0.0)
            if q[-1] == 0.0:
                found.append(total)
                q.pop(), e.pop()
            continue
        shift = (1.0 - 4 * EPS * len(q)) / sum(1.0 / d for d in probe[2])
        if total + shift == total:
            q, e, _ = probe
            continue
        tried = _step(q, e, shift)
        if min(tried[2]) < 0.0 or any(map(math.isnan, tried[0])):
            q, e, _ = probe
            continue
        q, e, _ = tried
        total += shift
    found.append(total + q[0])
    return sorted(found, reverse=True)


def twisted_vector(d: np.ndarray, low: np.ndarray, value: float, near: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Unit vector of L D L' at ``value`` from the twist with the smallest pivot, and the correction of the value.

    With ``near``, vectors already found for values next to this one, the
    factorisation is made a few units beside the value, where all of them
    weigh alike, and the twist is where most is left that ``near`` lacks.
    """
    beside = 32 * EPS * value if near else 0.0
    value = value + beside
    n = len(d)
    if n == 1:
        return np.ones(1), 0.0
    tiny = EPS * max(abs(value), 1e-300) * EPS
    s, plus = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if pivot != 0.0 else tiny
        plus[i] = low[i] * d[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p, minus = np.empty(n), np.empty(n - 1)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if pivot != 0.0 else tiny
        t = d[i] / pivot
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    if near:
        left = beside / np.maximum(np.abs(gamma), beside * EPS) - sum(v * v for v in near)
        at = int(np.argmax(left))
    else:
        at = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size2 = float(z @ z)
    return z / math.sqrt(size2), gamma[at] / size2


def _block_vectors(diag: np.ndarray, above: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """Right singular vectors of one unreduced block for its leading ``values``."""
    d, low = diag * diag, above / diag[:-1] if len(diag) > 1 else above
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [out[j] for j in range(i) if values[j] - value <= CLOSE * values[j]]
        tight = [v for j, v in enumerate(out) if values[j] - value <= 1e3 * EPS * values[j]]
        z, change = twisted_vector(d, low, value, tight)
        if not tight:
            better, again = twisted_vector(d, low, value + change)
            if abs(again) < abs(change):
                z = better
        for _ in range(2 if near else 0):
            for v in near:
                z = z - (v @ z) * v
            z = z / np.linalg.norm(z)
        out.append(z)
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values (falling), the leading ``most`` of them with right vectors as columns.

    Values that are zero to working precision have no vector.
    """
    diag, above, right = bidiagonalise(r)
    n = len(diag)
    norm = max(float(np.abs(diag).max(initial=0.0)), float(np.abs(above).max(initial=0.0)))
    if n == 0 or norm == 0.0:
        return np.zeros(n), np.zeros(0), np.zeros((n, 0))
    diag = np.where(np.abs(diag) <= EPS * norm, EPS * norm, diag)
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * norm) + 1).tolist(), n]
    blocks = list(zip(cuts, cuts[1:]))
    values = [squared_singular_values(diag[a:b] ** 2, above[a : b - 1] ** 2) for a, b in blocks]
    ranked = sorted(((v, k, i) for k, vs in enumerate(values) for i, v in enumerate(vs)), key=lambda t: (-t[0], t[1], t[2]))
    everything = np.array([v for v, _, _ in ranked])
    lead = [t for t in ranked[:most] if t[0] > (n * EPS) ** 2 * 100 * everything[0]]
    wanted = {k: sum(1 for t in lead if t[1] == k) for k, _ in enumerate(blocks)}
    found = {k: _block_vectors(diag[a:b], above[a : b - 1], values[k][: wanted[k]]) for k, (a, b) in enumerate(blocks) if wanted[k]}
    z = np.zeros((n, len(lead)))
    for c, (_, k, i) in enumerate(lead):
        a, b = blocks[k]
        z[a:b, c] = found[k][i]
    return everything, everything[: len(lead)], right @ z
