"""Leading eigenvectors of a symmetric matrix: tridiagonal form, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, and the unit Householder vectors, each from its row on."""
    a = np.array(a, np.float64)
    n, mirrors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x).max()
        v = np.zeros_like(x)
        if size > 0 and np.abs(x[1:]).max() > 0:
            x /= size
            v = x.copy()
            v[0] += np.copysign(np.linalg.norm(x), x[0])
            v /= np.linalg.norm(v)
            low = a[k + 1:, k + 1:]
            p = low @ v
            w = p - (v @ p) * v
            low -= 2 * (np.outer(v, w) + np.outer(w, v))
            x = x - 2 * (v @ x) * v
            a[k + 1:, k] = a[k, k + 1:] = x * size
        mirrors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), mirrors


def above(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix exceed each of some numbers (Sturm's count of signs)."""
    least = EPS * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)) ** 1 + np.finfo(np.float64).tiny
    q = d[0] - at
    count = (q > 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[i] - at - e[i - 1] ** 2 / q
        count += q > 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all their brackets together until no double lies between."""
    pad = np.concatenate([[0], np.abs(e), [0]])
    radius = pad[:-1] + pad[1:]
    span = max((d + radius).max() - (d - radius).min(), np.finfo(np.float64).tiny)
    low, high = np.full(k, (d - radius).min() - EPS * span), np.full(k, (d + radius).max() + EPS * span)
    wanted = np.arange(1, k + 1)
    for _ in range(200):
        middle = 0.5 * (low + high)
        if ((middle <= low) | (middle >= high) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        over = above(d, e, middle) >= wanted
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    return 0.5 * (low + high)


def _solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = b by elimination with row exchanges; vanishing pivots count as least."""
    n = len(d)
    main, upper, second, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    under = e.copy()
    for i in range(n - 1):
        if abs(under[i]) > abs(main[i]):
            main[i], under[i] = under[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        f = under[i] / main[i]
        main[i + 1] -= f * upper[i]
        upper[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        more = (upper[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - more) / main[i]
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Eigenvalues closer than a thousandth of the largest form a cluster; a vector is made orthogonal to those of its cluster
    after each step of inverse iteration. The entry of a vector that is largest in size is positive.
    """
    n = len(a)
    if n == 0 or k == 0:
        return np.zeros(0), np.zeros((0, n))
    size = np.abs(a).max()
    if n == 1 or size == 0:
        return np.diagonal(a)[:k].astype(np.float64), np.eye(n)[:k]
    d, e, mirrors = tridiagonal(a / size)
    values = leading_values(d, e, min(k, n))
    scale = max(np.abs(d).max(), np.abs(e).max())
    rng = np.random.default_rng(0)
    vectors: list[np.ndarray] = []
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * scale:
            cluster = i
        x = rng.standard_normal(n)
        for _ in range(5):
            x = _solved(d, e, value, x / np.linalg.norm(x), EPS * scale)
            x /= np.abs(x).max()
            for _ in range(2):
                for v in vectors[cluster:i]:
                    x -= (v @ x) * v
        vectors.append(x / np.linalg.norm(x))
    rows = np.array(vectors)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        rows[:, j + 1:] -= 2 * np.outer(rows[:, j + 1:] @ v, v)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    return values * size, rows
