"""Leading eigenpairs of a symmetric matrix by contour integration.

The projector onto the eigenvalues inside a circle is the contour integral of (z - A)^-1; a
quadrature over the upper half circle needs a few complex shifted solves.  Applied to a block
of vectors it keeps the wanted directions, Rayleigh-Ritz takes the eigenpairs out of their
span, and a few rounds reach working precision.

Sylvester's law of inertia counts the eigenvalues below a number without knowing them: they are
the negative pivots of L D L' of the shifted matrix, taken after a reduction to three diagonals.
Counts place the circles in the gaps of the spectrum and verify that no eigenvalue was missed.
"""

from __future__ import annotations

import numpy as np

POINTS = 8  # Gauss-Legendre points on the half circle
ROUNDS = 30
CLUSTER = 1e-9  # eigenvalues closer than this, relative to the largest, share a circle
_TIGHT = 1e-11


def three_diagonals(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix, by reflections."""
    m = a.copy()
    for i in range(len(m) - 2):
        v = m[i + 1 :, i].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size == 0:
            continue
        inner = m[i + 1 :, i + 1 :]
        w = inner @ v * (2 / size)
        w -= v * (w @ v / size)
        inner -= np.outer(v, w) + np.outer(w, v)
        m[i + 1 :, i] -= v * (2 * (v @ m[i + 1 :, i]) / size)
    return np.diag(m).copy(), np.diag(m, -1).copy()


class Inertia:
    """Counts of eigenvalues above a number."""

    def __init__(self, a: np.ndarray) -> None:
        diagonal, beside = three_diagonals(a)
        self.size = len(diagonal)
        self._diagonal, self._squares = diagonal.tolist(), [0.0, *(beside**2).tolist()]
        room = np.abs(np.append(beside, 0)) + np.abs(np.append(0, beside))
        self.low, self.high = float((diagonal - room).min()), float((diagonal + room).max())  # Gershgorin
        spread = max(self.high - self.low, abs(self.high), 1e-300)
        self.low, self.high = self.low - 0.01 * spread, self.high + 0.01 * spread

    def above(self, shift: float) -> int:
        pivot, count = 1.0, 0
        for d, s in zip(self._diagonal, self._squares):
            pivot = d - shift - s / pivot
            if pivot == 0:
                pivot = -1e-300
            count += pivot > 0
        return count

    def bracket(self, k: int, width: float) -> tuple[float, float]:
        """(low, high) around the ``k``-th largest eigenvalue, at most ``width`` apart."""
        low, high = self.low, self.high
        while high - low > width:
            middle = (low + high) / 2
            if middle in (low, high):
                break
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high


def circles(inertia: Inertia, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count): intervals from the top that hold the ``k`` largest eigenvalues, one for each cluster.

    Each reaches half way into the smaller of the gaps around its cluster.
    """
    scale = max(abs(inertia.low), abs(inertia.high))
    tight, near = _TIGHT * scale, CLUSTER * scale
    out: list[tuple[float, float, int]] = []
    found, ceiling = 0, inertia.high
    while found < k:
        top = inertia.bracket(found + 1, tight)[1]
        through = found + 1
        while True:
            last = inertia.bracket(through, tight)[0]
            wider = inertia.above(last - near)
            if wider == through:
                break
            through = wider
        floor = inertia.bracket(through + 1, tight)[1] if through < inertia.size else inertia.low
        margin = max(min(last - floor, ceiling - top), near / 2) / 2
        out.append((last - margin, top + margin, through - found))
        found, ceiling = through, last
    return out


def project(a: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs in an interval that holds ``count`` of them."""
    n = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    knots, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi / 2 * (1 - knots))
    block = np.linalg.qr(rng.normal(size=(n, min(n, count + 4))))[0]
    best, stalled = (np.inf, np.zeros(0), np.zeros((n, 0))), 0
    for _ in range(ROUNDS):
        image = np.zeros_like(block)
        for turn, weight in zip(turns, weights):
            shifted = (centre + radius * turn) * np.eye(n) - a
            image += (weight / 2 * radius * turn * np.linalg.solve(shifted, block)).real
        span = np.linalg.qr(image)[0]
        values, turned = np.linalg.eigh(span.T @ a @ span)  # Rayleigh-Ritz
        block = span @ turned
        errors = np.linalg.norm(a @ block - block * values, axis=0)
        # directions that the filter has emptied are noise, their values mean nothing
        inside = (values > low) & (values < high) & (errors < 1e-3 * radius)
        if inside.sum() != count:
            continue
        error = float(errors[inside].max())
        stalled = 0 if error < 0.5 * best[0] else stalled + 1
        if error < best[0]:
            best = (error, values[inside], block[:, inside])
        if stalled == 2:  # no more to gain
            break
    if len(best[1]) != count:
        raise ArithmeticError(f"an interval that holds {count} eigenvalues gave another number")
    return best[1], best[2]


def eigenpairs(a: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns (largest entry positive).

    An error is raised if a circle does not give as many eigenpairs as the inertia counts say.
    """
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).max()) if n else 0.0
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    even = (a + a.T) / (2 * scale)
    rng = np.random.default_rng(seed)
    pairs = [project(even, *circle, rng) for circle in circles(Inertia(even), k)]
    span = np.linalg.qr(np.concatenate([p[1] for p in pairs], axis=1))[0]
    values, turned = np.linalg.eigh(span.T @ even @ span)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = span @ turned[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values[order] * scale, vectors * signs
