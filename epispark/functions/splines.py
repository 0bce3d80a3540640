"""Natural cubic splines as column expressions (M1).

A natural spline is a cubic between knots, linear outside the boundary knots. The basis is built on the
driver from a handful of knots: each basis function is tabulated as one cubic per interval, and a column
expression picks the interval and evaluates it in Horner form. Fits depend only on the spanned space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NaturalSpline:
    """A basis of the natural splines with the given knots; without intercept it is zero at the first boundary."""

    boundary: tuple[float, float]
    knots: tuple[float, ...]
    intercept: bool = False

    @property
    def df(self) -> int:
        return len(self.knots) + 1 + self.intercept

    def _truncated(self, x: np.ndarray) -> np.ndarray:
        """The linear term and the natural truncated-power terms, in units of the boundary's width."""
        low, high = self.boundary
        t = np.r_[0.0, (np.asarray(self.knots) - low) / (high - low), 1.0]
        u = (np.asarray(x, dtype=float)[:, None] - low) / (high - low)
        cube = lambda k: np.clip(u - t[k], 0, None) ** 3
        d = lambda k: (cube(k) - cube(-1)) / (1 - t[k])
        last = len(t) - 2
        terms = [u] + [d(k) - d(last) for k in range(last)]
        if self.intercept:
            terms = [np.ones_like(u), *terms]
        return np.hstack(terms)

    def basis(self, x: np.ndarray) -> np.ndarray:
        """The basis at the points x: one row a point, ``df`` columns."""
        return self._truncated(x)

    def pieces(self) -> tuple[list[float], np.ndarray]:
        """(edges, coefficients[interval, basis, power of x - left edge]) with linear end intervals."""
        low, high = self.boundary
        edges = [low, *self.knots, high]
        out = []
        bounds = [(low - 1.0, low), *zip(edges[:-1], edges[1:]), (high, high + 1.0)]
        for a, b in bounds:
            x = np.linspace(a, b, 4)
            out.append(np.linalg.solve(np.vander(x - a, 4, increasing=True), self.basis(x)).T)
        return [low - 1.0, *edges], np.array(out)

    def columns(self, x: Column) -> list[Column]:
        """The basis functions of a column, each one CASE over the intervals."""
        starts, pieces = self.pieces()
        out = []
        for j in range(self.df):
            parts = [F.lit(float(c[j, 0])) + (x - s) * (F.lit(float(c[j, 1])) + (x - s) * (F.lit(float(c[j, 2])) + (x - s) * F.lit(float(c[j, 3])))) for s, c in zip(starts, pieces)]
            expr = F.when(x < starts[1], parts[0])
            for k in range(1, len(parts) - 1):
                expr = expr.when(x < starts[k + 1], parts[k])
            out.append(expr.when(x.isNotNull(), parts[-1]))
        return out


def equal_knots(low: float, high: float, df: int, intercept: bool = False) -> NaturalSpline:
    """``df`` functions with equally spaced inner knots."""
    inner = df - 1 - intercept
    return NaturalSpline((low, high), tuple(low + (high - low) * (i + 1) / (inner + 1) for i in range(inner)), intercept)


def lag_basis(lags: int, df: int = 4) -> NaturalSpline:
    """The basis over the lags 0..``lags``: with intercept, inner knots equally spaced."""
    return equal_knots(0.0, float(lags), df, intercept=True)
