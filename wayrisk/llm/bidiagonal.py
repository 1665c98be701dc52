"""Singular values and right singular vectors of a small upper triangular matrix.

Householder reflections make it bidiagonal; differential quotient-difference steps with shifts
(dqds) find the singular values, each to high relative accuracy; a twisted factorisation of the
shifted tridiagonal product gives each vector, from the place where it is largest outwards.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE = 1e-3  # relative gap below which vectors are made orthogonal to each other
SEED = 42


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the orthogonal V with U^T r V upper bidiagonal."""
    a = np.array(r, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.abs(x).max(initial=0.0)
        if size == 0 or not np.any(x[1:]):
            return x, 0.0
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w, 2.0 / (w @ w)

    for k in range(d):
        w, tau = reflector(a[k:, k].copy())
        if tau:
            a[k:, k:] -= np.outer(tau * w, w @ a[k:, k:])
        if k + 2 < d:
            w, tau = reflector(a[k, k + 1 :].copy())
            if tau:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, tau * w)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, tau * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One step; the last value is the smallest pivot, negative where the shift was too large."""
    n, d = len(q), q[0] - shift
    new_q, new_e, least = [0.0] * n, [0.0] * (n - 1), d
    for k in range(n - 1):
        total = d + e[k]
        new_q[k] = total
        if total <= 0.0:
            return new_q, new_e, min(d, -1.0)
        ratio = q[k + 1] / total
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        if d < least:
            least = d
    new_q[n - 1] = d
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / size) ** 2).tolist(), ((above / size) ** 2).tolist()
    found, parts, tiny = [], [(q, e, 0.0)], np.finfo(float).tiny
    while parts:
        q, e, moved = parts.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny or e[k] <= EPS * EPS * (moved + q[k + 1]) or e[k] <= EPS * EPS * (moved + q[k]) and e[k] <= EPS * EPS * q[k + 1]), None)
            if cut is not None and cut < len(q) - 2:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if cut is not None:
                found.append(moved + q.pop())
                e.pop()
                continue
            # smallest eigenvalue of the last two rows, from below
            a, b, c = q[-2], e[-1], q[-1]
            left = q[-2] + (e[-3 + 1] if len(e) > 1 else 0.0)
            right, off = c + b, a * b
            middle, half = (left + right) / 2, (left - right) / 2
            root = np.hypot(half, np.sqrt(off))
            low = (left * right - off) / (middle + root) if middle + root > 0 else 0.0
            shift = max(0.0, min(low, c) * (1 - 1e-9))
            for trial in (shift, shift / 2, shift / 8, 0.0):
                new_q, new_e, least = _dqds_step(q, e, trial)
                if least >= 0.0:
                    break
            else:  # rounding at a zero: the last value is zero
                new_q[-1], least = max(new_q[-1], 0.0), 0.0
                new_q = [max(x, 0.0) for x in new_q]
            q, e, moved = new_q, new_e, moved + trial
        found += [moved + x for x in q]
    return np.sort(np.array(found))[::-1] * size * size


class _Twisted:
    """Twisted factorisation of B^T B - shift, cut where the pivot is smallest."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, shift: float):
        n = len(diagonal)
        least = EPS * EPS * max((diagonal**2).max(initial=0.0), (above**2).max(initial=0.0), np.finfo(float).tiny)
        a = np.where(np.abs(diagonal) * np.abs(diagonal) < least * EPS, np.sqrt(least) * EPS, diagonal)
        pivot = lambda x: x if abs(x) > least * EPS else least * EPS
        q, off = a * a, a[:-1] * above
        self.down, self.up = np.zeros(n), np.zeros(n)  # pivots from the top and from the bottom
        self.low, self.high = np.zeros(n), np.zeros(n)  # multipliers
        s, stationary = -shift, np.zeros(n)
        for k in range(n - 1):
            stationary[k] = s
            self.down[k] = pivot(s + q[k])
            self.low[k] = off[k] / self.down[k]
            s = self.low[k] * (above[k] / a[k]) * s - shift
        stationary[n - 1] = s
        self.down[n - 1] = pivot(s + q[n - 1])
        p, progressive = q[n - 1] - shift, np.zeros(n)
        for k in range(n - 2, -1, -1):
            progressive[k + 1] = p = pivot(p)
            self.up[k + 1] = pivot(above[k] ** 2 + p)
            ratio = q[k] / self.up[k + 1]
            self.high[k] = off[k] / self.up[k + 1]
            p = p * ratio - shift
        progressive[0] = p
        self.up[0] = pivot(p)
        gamma = stationary + progressive + shift
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = pivot(gamma[self.at])

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.down))
        z[self.at] = 1.0
        self._outwards(z)
        return z / np.linalg.norm(z)

    def _outwards(self, z: np.ndarray, own: np.ndarray | None = None) -> None:
        for k in range(self.at - 1, -1, -1):
            z[k] = (0.0 if own is None else own[k]) - self.low[k] * z[k + 1]
        for k in range(self.at, len(z) - 1):
            z[k + 1] = (0.0 if own is None else own[k + 1]) - self.high[k] * z[k]

    def solve(self, right: np.ndarray) -> np.ndarray:
        n, r, w = len(right), self.at, right.copy()
        for k in range(r):
            w[k + 1] -= self.low[k] * w[k]
        last = w[r]
        for k in range(n - 1, r, -1):
            if k - 1 == r:
                last -= self.high[r] * w[k]
            else:
                w[k - 1] -= self.high[k - 1] * w[k]
        own = np.concatenate([w[:r] / self.down[:r], [0.0], w[r + 1 :] / self.up[r + 1 :]])
        z = np.zeros(n)
        z[r] = last / self.gamma
        self._outwards(z, own)
        return z


def right_vectors(r: np.ndarray, n_vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values (all, falling), and unit right singular vectors of the first ones as columns.

    Vectors of close values are found by inverse iteration, each kept orthogonal to the ones before.
    """
    diagonal, above, v = bidiagonal(r)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    values = squared_singular_values(diagonal, above)
    if size == 0:
        return values, v[:, :n_vectors]
    diagonal, above, scaled = diagonal / size, above / size, values / (size * size)
    random, found, group = np.random.default_rng(SEED), [], 0
    for k in range(n_vectors):
        # values below the rounding of the largest are one group, however far apart
        if k and scaled[k - 1] - scaled[k] > CLOSE * scaled[k - 1] and scaled[k - 1] > (len(scaled) * EPS) ** 2 * scaled[0]:
            group = k
        factors = _Twisted(diagonal, above, float(scaled[k]))
        z = factors.vector()
        if group < k or k + 1 < len(scaled) and scaled[k] - scaled[k + 1] <= CLOSE * scaled[k]:
            before = np.array(found[group:k]).reshape(k - group, len(z))
            if group < k:
                z = random.standard_normal(len(z))
            for _ in range(4):
                z -= before.T @ (before @ z)
                z = factors.solve(z / np.linalg.norm(z))
                for _ in range(3):
                    z /= np.linalg.norm(z)
                    z -= before.T @ (before @ z)
                z /= np.linalg.norm(z)
        found.append(z)
    out = v @ np.array(found).reshape(n_vectors, len(diagonal)).T
    return values, out / np.linalg.norm(out, axis=0)
