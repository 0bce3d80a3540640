"""Quantiles, normal and chi-square tails, array algebra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, approx: bool = False, out: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation (array ``out``), per group; ``approx`` for very large groups.

    Those of the whole table are found at once, by ``selected_quantiles``: no task gets all values.
    """
    if not by and not approx:
        found = selected_quantiles(df, column, probabilities)
        return df.sparkSession.createDataFrame([(None if None in found else found,)], f"{out} array<double>")
    q = F.percentile_approx(column, probabilities, 100_000) if approx else F.percentile(column, F.array(*[F.lit(p) for p in probabilities]))
    return df.groupBy(*(by or [])).agg(q.alias(out))


def patterns(x: np.ndarray) -> np.ndarray:
    """64-bit patterns of doubles whose unsigned order is that of the numbers (no NaN; -0.0 counts as 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def numbers(p: np.ndarray) -> np.ndarray:
    """The doubles that have these patterns."""
    sign = np.uint64(1 << 63)
    return np.where(p & sign, p & ~sign, ~p).view(np.float64)


def digit_counts(values: DataFrame, columns: list[str], wanted: dict[int, np.ndarray] | None, above: int, shift: int) -> pd.DataFrame:
    """(c, key, n): how many values of column number c have a pattern that is ``key`` without its last ``shift`` bits; of those
    whose pattern without the last ``above`` bits is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {c: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for c in range(len(columns))}
        for batch in batches:
            for c, (keys, counts) in totals.items():
                column = batch.column(c)
                x = column.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                p = patterns(x[~np.isnan(x)])
                if wanted is not None:
                    p = p[np.isin(p >> np.uint64(above), wanted[c])]
                fresh, n = np.unique(p >> np.uint64(shift), return_counts=True)
                merged, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
                totals[c] = merged, np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        for c, (keys, counts) in totals.items():
            yield pa.RecordBatch.from_pydict({"c": np.full(len(keys), c, np.int32), "key": keys.view(np.int64), "n": counts})

    return values.mapInArrow(run, "c int, key long, n long").groupBy("c", "key").agg(F.sum("n").alias("n")).toPandas()


def selected_quantiles(df: DataFrame, column: str | list[str], probabilities: list[float], digit: int = 16, most: int = 100_000):
    """Exact quantiles of a whole column, with linear interpolation, for tables of any size; for a list of columns a list for each.

    ``percentile`` over all rows ends in one task that holds every distinct value. Here ranks are selected by radix: a pass counts values
    by the first ``digit`` bits of their order-preserving patterns, the next one those that share the bits of a wanted rank by the bits
    that follow, so 64 / ``digit`` passes end it whatever the values are, infinities included. When ``most`` values at most
    are left, one pass reads them whole. A pass sends at most 2 ** digit counts a wanted rank to the driver. Nulls and NaN
    don't count; without values all quantiles are None. Between minus and plus infinity there is no quantile (NaN).
    """
    columns = [column] if isinstance(column, str) else list(column)
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).persist()
    try:
        found: list[dict[int, float]] = [{} for _ in columns]
        totals: list[int] = []
        open_: list[dict[int, tuple[int, list[int]]]] = []  # of each column: prefix -> (values below, ranks)
        left, above, wanted = None, 64, None
        while above:
            shift = 0 if left is not None and left <= most else above - digit
            counted, left = digit_counts(values, columns, wanted, above, shift), 0
            fresh: list[dict[int, tuple[int, list[int]]]] = []
            for c in range(len(columns)):
                own = counted[counted["c"] == c]
                keys = own["key"].to_numpy(np.int64).view(np.uint64)
                order = np.argsort(keys)
                keys, n = keys[order], own["n"].to_numpy(np.int64)[order]
                if wanted is None:
                    totals.append(int(n.sum()))
                    ranks = sorted({int(f(p * (totals[c] - 1))) for p in probabilities for f in (math.floor, math.ceil)}) if totals[c] else []
                    parts = {None: (0, ranks)}
                else:
                    parts = open_[c]
                inner: dict[int, tuple[int, list[int]]] = {}
                for prefix, (below, ranks) in parts.items():
                    at = slice(None) if prefix is None else keys >> np.uint64(above - shift) == np.uint64(prefix)
                    k, ends = keys[at], np.cumsum(n[at]) + below
                    for r in ranks:
                        i = int(np.searchsorted(ends, r, side="right"))
                        if shift:
                            inner.setdefault(int(k[i]), (int(ends[i] - n[at][i]), []))[1].append(r)
                        else:
                            found[c][r] = float(numbers(k[i : i + 1])[0])
                left += sum(int(n[np.searchsorted(keys, np.uint64(k))]) for k in inner)
                fresh.append(inner)
            open_, above = fresh, shift
            wanted = {c: np.array(list(x), np.uint64) for c, x in enumerate(open_)}
            if not any(open_):
                break
    finally:
        values.unpersist()

    def between(c: int, p: float) -> float | None:
        if not totals[c]:
            return None
        at = p * (totals[c] - 1)
        low, high = found[c][math.floor(at)], found[c][math.ceil(at)]
        return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    out = [[between(c, p) for p in probabilities] for c in range(len(columns))]
    return out[0] if isinstance(column, str) else out


def chi2_tail(x: float, k: float) -> float:
    """P(chi-square with k degrees of freedom > x): the regularised upper incomplete gamma function."""
    if not (x > 0 and k > 0):
        return 1.0 if x == x and k == k else float("nan")
    a, x = k / 2, x / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300  # continued fraction for the upper part
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) if a == a and b == b and a is not None and b is not None else np.nan for a, b in zip(x, k)])


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def grid(low: float, step: float, count: int) -> Column:
    """low, low + step, ...: by integer index, so that steps don't add up errors."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(low) + i * F.lit(step))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quadratic_form(d: Column, matrix: Column, n: int) -> Column:
    """d' M d with M flattened by columns."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(d, j) * dot(d, F.slice(matrix, j * n + 1, n)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def is_finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))
