"""Small dense arithmetic on cross products: growing factor, sweeps, lasso path, t tests.

Everything here works on the p x p sums that ``cross_products`` gathers, so its
cost does not depend on the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

__all__ = ["GrowingFactor", "LassoPath", "Swept", "student_p"]

#: Share of a column's own length below which its remainder counts as nothing.
DEPENDENT = 1e-10


class GrowingFactor:
    """Cholesky factor of the Gram matrix of the columns taken so far.

    A column is added in p^2 steps and refused if it is a combination of those
    before it; one is taken out by rotating the rows below it.
    """

    def __init__(self, size: int, tol: float = DEPENDENT) -> None:
        self.cols: list[int] = []
        self.tol = tol
        self._l = np.zeros((size, size))

    @property
    def factor(self) -> np.ndarray:
        n = len(self.cols)
        return self._l[:n, :n]

    def add(self, gram: np.ndarray, col: int) -> bool:
        """Whether the column went in."""
        n = len(self.cols)
        row = self._forward(gram[self.cols, col])
        own = gram[col, col]
        left = own - row @ row
        if own <= 0 or left <= self.tol * own:
            return False
        self._l[n, :n], self._l[n, n] = row, math.sqrt(left)
        self.cols.append(col)
        return True

    def drop(self, col: int) -> None:
        at, n = self.cols.index(col), len(self.cols)
        self._l[at:n - 1] = self._l[at + 1:n]
        self._l[n - 1] = 0.0
        for k in range(at, n - 1):
            a, b = self._l[k, k], self._l[k, k + 1]
            length = math.hypot(a, b)
            c, s = a / length, b / length
            left, right = self._l[k:n - 1, k].copy(), self._l[k:n - 1, k + 1].copy()
            self._l[k:n - 1, k], self._l[k:n - 1, k + 1] = c * left + s * right, c * right - s * left
        self._l[:n, n - 1] = 0.0
        del self.cols[at]

    def solve(self, right: np.ndarray) -> np.ndarray:
        """The Gram matrix of the columns divided into a vector."""
        out, l = self._forward(right), self.factor
        for i in range(len(out) - 1, -1, -1):
            out[i] = (out[i] - l[i + 1:, i] @ out[i + 1:]) / l[i, i]
        return out

    def _forward(self, right: np.ndarray) -> np.ndarray:
        out, l = np.array(right, dtype=float), self.factor
        for i in range(len(out)):
            out[i] = (out[i] - l[i, :i] @ out[:i]) / l[i, i]
        return out


class Swept:
    """Sums around the means with columns swept in: slopes, their variances and the rest of squares at once.

    Columns come in by number; one that is a combination of those before it stays
    out, with slope 0. A sweep costs p^2, so every column's effect on the rest of
    squares is known without a solve.
    """

    def __init__(self, sxx: np.ndarray, sxy: np.ndarray, syy: float, tol: float = DEPENDENT) -> None:
        p = len(sxy)
        self._a = np.zeros((p + 1, p + 1))
        self._a[:p, :p], self._a[:p, p], self._a[p, :p], self._a[p, p] = sxx, sxy, sxy, syy
        self.cols: list[int] = []
        for j in range(p):
            if sxx[j, j] > 0 and self._a[j, j] > tol * sxx[j, j]:
                self._sweep(j)
                self.cols.append(j)

    def _sweep(self, k: int) -> None:
        a = self._a
        pivot = a[k, k]
        row, col = a[k] / pivot, a[:, k].copy()
        a -= np.outer(col, row)
        a[k], a[:, k] = row, -col / pivot
        a[k, k] = 1 / pivot

    def drop(self, col: int) -> None:
        self._sweep(col)
        self.cols.remove(col)

    @property
    def rest(self) -> float:
        """Sum of squares that the columns leave."""
        return max(float(self._a[-1, -1]), 0.0)

    @property
    def slopes(self) -> np.ndarray:
        out = np.zeros(len(self._a) - 1)
        out[self.cols] = self._a[self.cols, -1]
        return out

    @property
    def inverse(self) -> np.ndarray:
        """Inverse of the swept columns' sums, in their order."""
        return self._a[np.ix_(self.cols, self.cols)]

    def rest_without(self) -> np.ndarray:
        """The rest of squares after each swept column is taken out."""
        return self.rest + self._a[self.cols, -1] ** 2 / np.diag(self._a)[self.cols]


@dataclass
class LassoPath:
    """Solutions at the knots of the lasso path; between two of them every slope is linear."""

    penalties: np.ndarray
    slopes: np.ndarray

    @property
    def norms(self) -> np.ndarray:
        return np.abs(self.slopes).sum(axis=1)

    def at_share(self, share: float) -> np.ndarray:
        """Slopes whose L1 norm is this share of that at the end of the path."""
        norms = self.norms
        goal = min(max(share, 0.0), 1.0) * norms[-1]
        k = int(np.searchsorted(norms, goal))
        if k == 0 or norms[k] == norms[k - 1]:
            return self.slopes[k].copy()
        part = (goal - norms[k - 1]) / (norms[k] - norms[k - 1])
        return (1 - part) * self.slopes[k - 1] + part * self.slopes[k]

    @classmethod
    def trace(cls, gram: np.ndarray, pull: np.ndarray) -> LassoPath:
        """The whole path from no column to least squares, one knot a step.

        ``gram`` has ones on its diagonal. The columns in use share the largest
        absolute pull on what is left of the target. They move together until a
        further column reaches that pull, or one of them reaches 0 and leaves. A
        column that is a combination of those in use is passed over.
        """
        p = len(pull)
        usable = np.diag(gram) > 0
        factor = GrowingFactor(p)
        b, left = np.zeros(p), np.where(usable, pull, 0.0)
        signs = np.zeros(p)
        small = 1e-12 * max(float(np.abs(left).max(initial=0.0)), 1e-300)
        barred = ~usable
        # Columns that left, or were refused, at the present penalty.
        waiting: set[int] = set()
        penalties, knots = [float(np.abs(left).max(initial=0.0))], [b.copy()]
        while True:
            height = float(np.abs(left[factor.cols]).max()) if factor.cols else float(np.abs(left[~barred]).max(initial=0.0))
            if height <= small:
                break
            for j in np.flatnonzero(~barred & (np.abs(left) >= height - small)):
                if j in factor.cols or j in waiting:
                    continue
                if factor.add(gram, int(j)):
                    signs[j] = math.copysign(1.0, left[j])
                else:
                    barred[j] = True
            used = factor.cols
            if not used:
                break
            move = factor.solve(signs[used])
            # A column at 0 that would move against its pull stays out until the penalty falls.
            against = [j for j, m in zip(used, move, strict=True) if b[j] == 0 and m * signs[j] < 0]
            if against:
                factor.drop(against[-1])
                waiting.add(against[-1])
                continue
            fall = gram[:, used] @ move
            step, leaving = height, None
            others = ~barred
            others[used] = False
            for sign in (1.0, -1.0):
                closing = 1 - sign * fall
                gap = height - sign * left
                able = others & (closing > 1e-14)
                if waiting:
                    able &= gap > small
                if able.any():
                    step = min(step, float(np.maximum(gap[able] / closing[able], 0.0).min()))
            for j, m in zip(used, move, strict=True):
                if b[j] * m < 0 and -b[j] / m <= step:
                    step, leaving = -b[j] / m, j
            b[used] += step * move
            left -= step * fall
            if step > 0:
                waiting.clear()
            if leaving is not None:
                b[leaving] = 0.0
                factor.drop(leaving)
                waiting.add(leaving)
            penalties.append(height - step)
            knots.append(b.copy())
        return cls(np.array(penalties), np.array(knots))


def student_p(t: float, df: float) -> float:
    """Two-sided p value of a t statistic: the incomplete beta function as a continued fraction."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    # The fraction converges fast on this side of the mean; the other side is its complement.
    if x < (a + 1) / (a + b + 2):
        return _beta_tail(x, a, b)
    return 1 - _beta_tail(1 - x, b, a)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function where a or b is 1/2, the fraction evaluated from its front until it stands still."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + _half_step(a + b - 0.5) - math.lgamma(0.5)) / a
    value, above, below, k = 1.0, math.inf, 1.0, 0
    while abs(above * below - 1) > 1e-15:
        k += 1
        half = k // 2
        top = half * (b - half) if k % 2 == 0 else -(a + half) * (a + b + half)
        term = top * x / ((a + k - 1) * (a + k))
        below = 1 / ((1 + term * below) or 1e-300)
        above = (1 + term / above) or 1e-300
        value *= above * below
    return front * value


def _half_step(h: float) -> float:
    """Logarithm of gamma(h + 1/2) over gamma(h); the plain difference loses digits where h is large."""
    if h < 1000:
        return math.lgamma(h + 0.5) - math.lgamma(h)
    return 0.5 * math.log(h) - 1 / (8 * h) + 1 / (192 * h ** 3)
