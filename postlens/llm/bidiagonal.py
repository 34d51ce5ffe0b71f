"""Singular values and right singular vectors of one small square matrix, to high relative accuracy.

Householder reflections from both sides make it bidiagonal; differential
quotient-difference steps with shifts (dqds) find the singular values; twisted
factorisations of the bidiagonal's Gram matrix, shifted by an eigenvalue, give
the vectors. Vectors of eigenvalues that hardly differ are found by inverse
iteration with the same factorisations, each kept orthogonal to those before.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
CLOSE = 1e-3
ROUNDS = 12


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right): matrix = left @ bidiagonal @ right.T with orthogonal factors; left isn't kept."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    right = np.eye(d)
    for k in range(d):
        v, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 1:
            v, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta) such that x - beta v (v.x) has only a first entry."""
    v = x.copy()
    scale = np.abs(x).max(initial=0.0)
    if not scale or not np.any(x[1:]):
        return v, 0.0
    v /= scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v, 2.0 / (v @ v)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of the Gram matrix of a bidiagonal with squared entries q (diagonal) and e (beside it)."""
    found: list[float] = []
    parts = [(np.array(q, dtype=np.float64), np.array(e, dtype=np.float64), 0.0)]
    while parts:
        q, e, shift = parts.pop()
        while len(q):
            # An entry beside the diagonal that is nothing to both its neighbours splits the matrix.
            cut = np.flatnonzero(e <= EPS * EPS * (shift + np.minimum(q[:-1], q[1:])))
            if len(cut) and cut[-1] == len(q) - 2:
                found.append(shift + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if len(cut):
                at = cut[-1]
                parts.append((q[: at + 1], e[:at], shift))
                q, e = q[at + 1 :], e[at + 1 :]
            if len(q) == 1:
                found.append(shift + q[0])
                break
            q, e, step = shifted_step(q, e)
            shift += step
    return np.maximum(np.sort(np.array(found))[::-1], 0.0)


def shifted_step(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step by a shift below the least eigenvalue: first a bold one, at last none."""
    plain_q, plain_e, least = step(q, e, 0.0)
    if not np.all(plain_q > 0) or least <= 0:
        return plain_q, plain_e, 0.0
    # 1 / d sums to the trace of the inverse, so its reciprocal is no larger than the least eigenvalue.
    safe = 1.0 / (1.0 / least_pivots(q, e)).sum()
    for bold in (least * (1 - 4 * EPS), (least + safe) / 2, safe * (1 - 8 * EPS)):
        moved_q, moved_e, low = step(q, e, bold)
        if low >= 0 and np.all(moved_q > 0) and np.all(np.isfinite(moved_e)):
            return moved_q, moved_e, bold
    return plain_q, plain_e, 0.0


def least_pivots(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    d = np.empty(len(q))
    d[0] = q[0]
    for i in range(len(e)):
        d[i + 1] = d[i] * (q[i + 1] / (d[i] + e[i]))
    return np.maximum(d, np.finfo(np.float64).tiny)


def step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The next q and e after one differential step, and the least pivot on the way (negative: the shift was too large)."""
    new_q, new_e = np.empty(len(q)), np.empty(len(e))
    d = least = q[0] - shift
    with np.errstate(all="ignore"):
        for i in range(len(e)):
            new_q[i] = d + e[i]
            ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
            if not d >= 0:
                return new_q, new_e, -1.0
            least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, float(least)


def twisted(q: np.ndarray, e: np.ndarray, value: float):
    """Gram - value factored from the top and from the bottom: (factors, pivots) of each, pivots of meeting, best place."""
    n, tiny = len(q), EPS * EPS * max(q.max(), value)
    beside = np.sqrt(q[:-1]) * np.sqrt(e)
    down, up, upper, lower = np.empty(n - 1), np.empty(n - 1), np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        upper[i] = pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = beside[i] / pivot
        s[i + 1] = e[i] * (s[i] / pivot) - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        lower[i] = pivot = pivot if abs(pivot) > tiny else tiny
        up[i] = beside[i] / pivot
        p[i] = p[i + 1] * (q[i] / pivot) - value
    meet = s + p + value
    return down, up, upper, lower, meet, int(np.argmin(np.abs(meet)))


def twisted_vector(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of the Gram matrix at ``value``, from the twisted factorisation alone."""
    down, up, _, _, _, at = twisted(q, e, value)
    z = np.zeros(len(q))
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, len(q) - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def solved(q: np.ndarray, e: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """(Gram - value) x = b by the twisted factorisation; a vanishing pivot where the two meet counts as a rounding."""
    down, up, upper, lower, meet, at = twisted(q, e, value)
    n, least = len(q), EPS * max(q.max(), value)
    y = b.astype(np.float64).copy()
    for i in range(at):
        y[i + 1] -= down[i] * y[i]
    for i in range(n - 1, at, -1):
        y[i - 1] -= up[i - 1] * y[i]
    middle = meet[at] if abs(meet[at]) > least else least
    x = y / np.concatenate([upper[:at], [middle], lower[at:]])
    for i in range(at - 1, -1, -1):
        x[i] -= down[i] * x[i + 1]
    for i in range(at, n - 1):
        x[i + 1] -= up[i] * x[i]
    return x


def block_vectors(q: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the Gram matrix of a bidiagonal without zeros, for its largest eigenvalues, falling."""
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(13)
    main, beside = q + np.append(0.0, e), np.sqrt(q[:-1]) * np.sqrt(e)
    for i, value in enumerate(values):
        near = [v for j, v in enumerate(vectors) if values[j] - value <= CLOSE * values[j]]
        alone = not near and (i + 1 == len(values) or value - values[i + 1] > CLOSE * value)
        z = twisted_vector(q, e, value) if alone else rng.standard_normal(len(q))
        best, off = z, np.inf
        for turn in range(ROUNDS):
            z /= np.linalg.norm(z)
            for _ in range(3 if near else 0):
                for other in near:
                    z -= (other @ z) * other
                z /= np.linalg.norm(z)
            rest = (main - value) * z
            rest[:-1] += beside * z[1:]
            rest[1:] += beside * z[:-1]
            if np.linalg.norm(rest) < off:
                best, off = z.copy(), np.linalg.norm(rest)
            if off <= 2 * len(q) * EPS * main.max():
                break
            z = solved(q, e, value, z) if turn % 4 < 3 else rng.standard_normal(len(q))
        vectors.append(best)
    return np.array(vectors).reshape(-1, len(q)).T


def right_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; unit right singular vectors of the first ``count`` that aren't nothing).

    An entry of the bidiagonal below the rounding of the reflections (their number times the largest) is nothing:
    beside the diagonal it parts the matrix into blocks that are solved apart.
    """
    diagonal, beside, right = bidiagonalise(matrix)
    d, largest = len(diagonal), max(np.abs(diagonal).max(initial=0.0), np.abs(beside).max(initial=0.0))
    if not largest:
        return np.zeros(d), np.zeros((d, 0))
    least = EPS * d * largest
    sign = np.where(diagonal < 0, -1.0, 1.0)
    q = np.maximum(np.abs(diagonal) / largest, EPS / 8) ** 2
    e = np.where(np.abs(beside) <= least, 0.0, beside / largest) ** 2
    # The Gram matrix has diagonal * beside next to its diagonal: signs of the vectors' entries follow from theirs.
    turn = np.cumprod(np.append(1.0, sign[:-1] * np.where(beside < 0, -1.0, 1.0)))
    edges = [0, *(np.flatnonzero(e == 0) + 1).tolist(), d]
    found = []
    for low, high in zip(edges, edges[1:]):
        found += [(value, low, high, i) for i, value in enumerate(dqds(q[low:high], e[low : high - 1]))]
    found.sort(key=lambda f: (-f[0], f[1], f[3]))
    values = np.array([f[0] for f in found])
    kept = [f for f in found[:count] if f[0] > (EPS * d) ** 2 * values[0]]
    columns = np.zeros((d, len(kept)))
    for low, high in zip(edges, edges[1:]):
        mine = [i for i, f in enumerate(kept) if f[1] == low]
        if mine:
            more = [f[0] for f in found if f[1] == low][: len(mine) + 1]
            columns[low:high, mine] = block_vectors(q[low:high], e[low : high - 1], np.array(more))[:, : len(mine)]
    return values * largest**2, right @ (columns * turn[:, None])
