"""Largest eigenpairs of a symmetric matrix by contour integration.

The spectrum's upper end is cut into intervals whose borders lie in gaps; inertia counts (signs of the pivots of a
shifted tridiagonal form) say how many eigenvalues each one holds. For each interval a rational filter, the quadrature
of (zI - A)^-1 Y along a circle through the interval's ends, projects a random block onto the wanted subspace; Rayleigh-
Ritz extracts eigenpairs, and the projection is repeated until as many of them as were counted have converged.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the upper half of each circle, and eigenvalues of an interval unless a cluster holds more.
POINTS, PER_INTERVAL = 12, 8
_EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix similar to the symmetric a, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        part = a[k + 1 :, k + 1 :]
        p = part @ x
        p -= (x @ p) * x
        part -= 2 * (np.outer(x, p) + np.outer(p, x))
        side = a[k + 1 :, k]
        side -= 2 * (x @ side) * x
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(n - 1)])


def count_above(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: the positive pivots of the shifted tridiagonal matrix (Sylvester's law)."""
    tiny = np.finfo(float).tiny / _EPS
    q = diag[0] - at
    count = (q > 0).astype(int)
    for d, e in zip(diag[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, np.where(q < 0, -tiny, tiny), q)
        count += q > 0
    return count


def located(diag: np.ndarray, off: np.ndarray, many: int, scale: float, steps: int = 52) -> np.ndarray:
    """The `many` largest eigenvalues, falling, by bisection on the counts."""
    lo, hi = np.full(many, -scale), np.full(many, scale)
    rank = np.arange(1, many + 1)
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = count_above(diag, off, mid) >= rank
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _intervals(values: np.ndarray, wanted: int, scale: float) -> list[tuple[float, float]]:
    """(low, high) of intervals that hold the wanted largest values and the clusters that they belong to, from above.

    Borders lie in the middle of the widest gap near every eighth value; a gap narrower than rounding is none.
    """
    gaps = np.append(-np.diff(values), np.inf)
    wide = np.flatnonzero(gaps > 1e4 * _EPS * scale)
    border = lambda i: (values[i] + values[i + 1]) / 2 if i + 1 < len(values) else values[i] - max(0.01 * scale, values[i])
    out, first, high = [], 0, values[0] + 0.01 * scale
    while first < wanted:
        near = wide[(wide >= first) & (wide < first + PER_INTERVAL)]
        last = int(near[np.argmax(gaps[near])]) if len(near) else int(wide[wide >= first][0])
        if last < wanted - 1 and wanted <= first + PER_INTERVAL and (ends := wide[wide >= wanted - 1])[0] < first + PER_INTERVAL:
            last = int(ends[0])  # the rest fits one interval
        out.append((float(border(last)), float(high)))
        first, high = last + 1, border(last)
    return out


def _rayleigh_ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = np.linalg.qr(q)[0]
    values, small = np.linalg.eigh((h := q.T @ a @ q) / 2 + h.T / 2)
    return values, q @ small


def _project(a: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The spectral projector of the interval, approximated by a quadrature along the circle through its ends, applied to y."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    middle, radius, unit = (low + high) / 2, (high - low) / 2, np.eye(len(a))
    total = np.zeros_like(y)
    for t, weight in zip(np.pi * (x + 1) / 2, w / 2, strict=True):
        turn = np.exp(1j * t)
        total += weight * (radius * turn * np.linalg.solve((middle + radius * turn) * unit - a, y.astype(complex))).real
    return total


def interval_pairs(a: np.ndarray, low: float, high: float, count: int, scale: float, seed: int = 1, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs of a between low and high; raises if they cannot all be found."""
    rng, extra = np.random.default_rng(seed), 4
    while True:
        width = min(len(a), count + max(extra, count // 2))
        y = rng.standard_normal((len(a), width))
        best = None
        for _ in range(rounds):
            values, y = _rayleigh_ritz(a, _project(a, y, low, high))
            inside = (values > low) & (values <= high)
            error = np.linalg.norm(a @ y - y * values, axis=0)
            good = inside & (error <= 1e3 * _EPS * scale)
            worst = error[inside].max(initial=0.0)
            if good.sum() == count == inside.sum():
                if best is not None and worst >= best[0] / 2:  # no round makes them better
                    return best[1:] if best[0] <= worst else (values[inside], y[:, inside])
                best = (worst, values[inside], y[:, inside])
        if best is not None:
            return best[1:]
        if width == len(a):
            raise ArithmeticError(f"of {count} eigenvalues counted between {low} and {high}, {good.sum()} were found")
        extra *= 2


def largest_pairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` largest positive eigenvalues of a positive semidefinite matrix, falling, and unit eigenvectors (columns).

    Eigenvalues that rounding cannot tell from zero are left out. The largest entry of each vector is positive. Raises
    ArithmeticError if an interval holds more eigenvalues, by inertia, than were found.
    """
    n = len(a)
    scale = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    a = (a + a.T) / (2 * scale)
    diag, off = tridiagonal(a)
    positive = int(count_above(diag, off, np.array([n * 8 * _EPS]))[0])
    wanted = min(most, positive)
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    values = located(diag, off, n, 2.0)
    found = []
    for low, high in _intervals(values, wanted, 1.0):
        above = count_above(diag, off, np.array([low, high]))
        found.append(interval_pairs(a, low, high, int(above[0] - above[1]), 1.0)[1])
    values, vectors = _rayleigh_ritz(a, np.hstack(found))  # together once more, so that all are orthogonal
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order] * scale, vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(wanted)] < 0, -1.0, 1.0)
