"""Singular values and right singular vectors of a triangular matrix, of the size of a vector's dimension.

Householder reflections make it bidiagonal; the differential qd algorithm (with shifts that are lower bounds,
so every quantity stays positive) gives the squared singular values to high relative accuracy; for each of
them, a stationary and a progressive factorisation meet where their twist is smallest, and the twisted
factor is solved for the vector. Vectors of close values are made orthogonal, from another twist if need be.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: an off-diagonal square this small against what it would change is none
_NONE = (8 * EPS) ** 2
#: values closer than this have their vectors made orthogonal
_CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """u and beta such that x - beta * u * (u @ x) has zeros behind its first entry."""
    u = x.copy()
    tail = float(u[1:] @ u[1:])
    if tail == 0.0:
        return u, 0.0
    u[0] += np.copysign(np.sqrt(u[0] * u[0] + tail), u[0])
    return u, 2.0 / (u[0] * u[0] + tail)


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B and an orthogonal V, where matrix @ V = U @ B for some orthogonal U."""
    a = np.array(matrix, np.float64)
    n = len(a)
    v = np.eye(n)
    for k in range(n):
        u, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * u, u @ a[k:, k:])
        if k < n - 2:
            w, beta = _reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ w, beta * w)
                v[:, k + 1:] -= np.outer(v[:, k + 1:] @ w, beta * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _lower_bound(q: list, e: list) -> float:
    """One over the trace of the inverse: under the smallest value, and close to it once that stands alone."""
    z = 1.0 / q[0]
    total = z
    for k in range(1, len(q)):
        z = (1.0 + e[k - 1] * z) / q[k]
        total += z
    return 1.0 / total


def _step(q: list, e: list, shift: float):
    """One differential qd step with a shift; None where the shift was too large."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        x = d + e[k]
        t = q[k + 1] / x
        new_q.append(x)
        new_e.append(e[k] * t)
        d = d * t - shift
    if not d >= 0:
        return None
    new_q.append(d)
    return new_q, new_e


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix without zeros on its diagonal, descending."""
    todo = [([float(x) * float(x) for x in diagonal], [float(x) * float(x) for x in superdiagonal], 0.0)]
    out = []
    while todo:
        q, e, moved = todo.pop()
        while q:
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _NONE * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:  # small values leave at the end
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e) if min(q) > 0 else 0.0
            after = _step(q, e, shift)
            for less in (1e-12, 1e-6, 0.5, 1.0):
                if after is not None:
                    break
                after, shift = _step(q, e, shift * (1 - less)), shift * (1 - less)
            q, e = after
            moved += shift
    return np.sort(np.array(out))[::-1]


def _twists(d: np.ndarray, low: np.ndarray, value: float):
    """The two factorisations of L D L' - value, and the twist at every place."""
    n = len(d)
    tiny = EPS * EPS * (abs(value) + float(d.max()))
    down, up = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        x = s[k] + d[k]
        x = x if abs(x) > tiny else tiny
        down[k] = d[k] * low[k] / x
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        x = d[k] * low[k] * low[k] + p[k + 1]
        x = x if abs(x) > tiny else tiny
        t = d[k] / x
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    return down, up, s + p + value


def _twisted(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, len(down)):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _block_vectors(diagonal: np.ndarray, superdiagonal: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unreduced bidiagonal block, for its values in descending order."""
    n = len(diagonal)
    if n == 1:
        return np.ones((1, 1))
    d, low = diagonal * diagonal, superdiagonal / diagonal[:-1]
    out = np.empty((n, len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > _CLOSE * values[j - 1]:
            first = j
        down, up, gamma = _twists(d, low, float(value))
        near = out[:, first:j]
        best, left = None, -1.0
        for at in np.argsort(np.abs(gamma), kind="stable"):
            z = _twisted(down, up, int(at))
            rest = z - near @ (near.T @ z)
            size = float(np.linalg.norm(rest))
            if np.isfinite(size) and size > left:
                best, left = rest, size
            if left > 0.5:
                break
        best = best / left
        best -= near @ (near.T @ best)
        out[:, j] = best / np.linalg.norm(best)
    return out


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, descending, and right singular vectors as columns, of a square matrix.

    Values that are zero to the precision of the largest come with it as values near zero."""
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if scale == 0.0:
        return np.zeros(n), np.eye(n)
    diagonal, above, v = bidiagonalise(np.asarray(matrix, np.float64) / scale)
    floor = 1e-20 * max(float(np.abs(diagonal).max()), float(np.abs(above).max(initial=0.0)))
    diagonal = np.where(np.abs(diagonal) < floor, floor, diagonal)
    weak = above * above <= _NONE * np.minimum(diagonal[:-1] ** 2, diagonal[1:] ** 2)
    borders = [0, *(np.flatnonzero(weak) + 1).tolist(), n]
    values, vectors = [], np.zeros((n, n))
    for a, b in zip(borders, borders[1:]):
        found = dqds(diagonal[a:b], above[a:b - 1])
        vectors[a:b, a:b] = _block_vectors(diagonal[a:b], above[a:b - 1], found)
        values.append(found)
    values = np.concatenate(values)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, v @ vectors[:, order]
