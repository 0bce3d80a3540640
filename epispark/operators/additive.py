"""Poisson regression on long series, by sums over rows.

A Newton step needs only X'WX, X'Wz and a few totals. Tasks sum them for the rows they hold, whatever key those belong to, so one key
may be spread over any number of tasks; partial sums are added up in a tree, and one small matrix a key reaches the driver. That is for
few and long series (``LARGEST`` bounds what is collected); many short ones are ``dlnm.fit_regions``'.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of sums that the driver collects in a step at most.
LARGEST = 1 << 28


@dataclass
class Sums:
    """X'WX, X'Wz, z'Wz, rows, sum of counts, deviance and Pearson's chi-square at the coefficients that they were made with."""

    gram: np.ndarray
    rhs: np.ndarray
    zz: float
    n: float
    total: float
    deviance: float
    pearson: float

    @classmethod
    def of(cls, flat: np.ndarray, p: int) -> Sums:
        return cls(flat[: p * p].reshape(p, p), flat[p * p : p * p + p], *flat[p * p + p :].tolist())


def working(x: np.ndarray, y: np.ndarray, beta: np.ndarray | None) -> np.ndarray:
    """The flat sums of some rows. Without coefficients the fit starts at the counts themselves."""
    eta = np.log(y + 0.1) if beta is None else np.clip(x @ beta, -30, 30)
    mu = np.exp(eta)
    z = eta + (y - mu) / mu
    weighted = x * mu[:, None]
    deviance = 2 * np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0) - (y - mu))
    return np.concatenate([(x.T @ weighted).ravel(), weighted.T @ z, [mu @ (z * z), len(y), y.sum(), deviance, np.sum((y - mu) ** 2 / mu)]])


def summed(rows: DataFrame, keys: tuple[str, ...], columns: list[str], y: str, design: Callable[[tuple, dict], np.ndarray], p: int, betas: dict[tuple, np.ndarray | None] | None) -> dict[tuple, Sums]:
    """The sums of each key (of all rows, without keys). ``design(key, arrays by column)`` makes the rows' regressors in the task."""
    kinds = [f for f in rows.schema.fields if f.name in keys]
    kinds.sort(key=lambda f: keys.index(f.name))
    schema = T.StructType([*kinds, T.StructField("s", T.BinaryType())])

    def packed(totals: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if totals:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in totals]) for i in range(len(keys))), pa.array([v.tobytes() for v in totals.values()], pa.binary())], [*keys, "s"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            named = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * len(batch)
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(named):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                part = batch.take(pa.array(at))
                x = design(k, {c: np.stack(part.column(c).to_numpy(zero_copy_only=False)) if pa.types.is_list(part.column(c).type) else part.column(c).to_numpy(zero_copy_only=False) for c in columns})
                add = working(x, part.column(y).to_numpy(zero_copy_only=False), betas[k] if betas else None)
                totals[k] = totals[k] + add if k in totals else add
        yield from packed(totals)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *k, s in zip(*[c.to_pylist() for c in batch.columns]):
                add = np.frombuffer(s)
                totals[tuple(k)] = totals[tuple(k)] + add if tuple(k) in totals else add
        yield from packed(totals)

    ready = rows.select(*keys, *dict.fromkeys([*columns, y])).withColumn(y, F.col(y).cast("double"))
    parts = ready.mapInArrow(first, schema)
    width = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found: dict[tuple, np.ndarray] = {}
    for r in parts.repartition(width, F.rand(7)).mapInArrow(again, schema).collect():
        k, s = tuple(r[:-1]), np.frombuffer(r["s"])
        found[k] = found[k] + s if k in found else s
    return {k: Sums.of(v, p) for k, v in found.items()}


def settled_fit(rows: DataFrame, keys: tuple[str, ...], columns: list[str], y: str, design: Callable, p: int, solve: Callable[[tuple, Sums], np.ndarray], steps: int = 50, tolerance: float = 1e-9) -> dict[tuple, tuple[np.ndarray, Sums, str, int]]:
    """(coefficients, sums there, status, steps) of each key: Newton steps with halving. Status is ``success`` when the deviance
    has settled, ``not settled`` after ``steps`` steps, ``error`` where the sums are not finite. The rows are read once a step: persist them."""
    now = summed(rows, keys, columns, y, design, p, None)
    betas: dict[tuple, np.ndarray] = {k: solve(k, s) for k, s in now.items()}
    before: dict[tuple, tuple[np.ndarray, Sums]] = {}
    status, took = dict.fromkeys(now, "not settled"), dict.fromkeys(now, steps)
    open_, halved = set(now), dict.fromkeys(now, 0)
    for step in range(1, steps + 1):
        held = betas
        found = summed(rows, keys, columns, y, lambda k, c: design(k, c), p, held)
        for k in sorted(open_, key=repr):
            s = found[k]
            if k in before and not s.deviance <= before[k][1].deviance + 1e-8 * (abs(before[k][1].deviance) + 0.1) and halved[k] < 20:
                betas = betas | {k: (betas[k] + before[k][0]) / 2}
                halved[k] += 1
                continue
            halved[k] = 0
            if not np.isfinite(s.gram).all():
                status[k], took[k] = "error", step
                open_ = open_ - {k}
                continue
            done = k in before and abs(s.deviance - before[k][1].deviance) <= tolerance * (abs(s.deviance) + 0.1)
            before[k] = (betas[k], s)
            if done:
                status[k], took[k] = "success", step
                open_ = open_ - {k}
            else:
                betas = betas | {k: solve(k, s)}
        if not open_:
            break
    return {k: (*before[k], status[k], took[k]) for k in now if k in before}


def plain_step(key: tuple, s: Sums) -> np.ndarray:
    """The unpenalised Newton step; columns that add nothing get zero."""
    unit = np.sqrt(np.maximum(np.diag(s.gram), 1e-300))
    return np.linalg.lstsq(s.gram / np.outer(unit, unit), s.rhs / unit, rcond=1e-10)[0] / unit


def fit_long(rows: DataFrame, keys: tuple[str, ...] = (), x: str = "x", y: str = "deaths", steps: int = 50) -> DataFrame:
    """Quasi-Poisson regression of each key's rows on the array column ``x``: one row a key, however many rows it has.

    Columns: status (success, not settled or error), n_rows, n_deaths, n_steps, dispersion, coef, vcov (flattened by columns).
    Rows with a null in ``x`` or ``y`` don't count. Collinear columns share what they can't tell apart.
    """
    ready = rows.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.forall(x, lambda v: v.isNotNull())).persist()
    try:
        return _fit_long(ready, keys, x, y, steps)
    finally:
        ready.unpersist()


def _fit_long(ready: DataFrame, keys: tuple[str, ...], x: str, y: str, steps: int) -> DataFrame:
    width = ready.select(F.max(F.size(x)).alias("p"), F.count_distinct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("k") if keys else F.lit(1).alias("k")).first()
    schema = T.StructType([*[f for k in keys for f in ready.schema.fields if f.name == k], *T.StructType.fromDDL("status string, n_rows bigint, n_deaths double, n_steps int, dispersion double, coef array<double>, vcov array<double>").fields])
    p = width["p"] or 0
    if width["k"] * p * p * 8 > LARGEST:
        raise ValueError("too many keys for sums on the driver: fit them with dlnm.fit_regions")
    out = []
    for k, (beta, s, status, took) in settled_fit(ready, keys, [x], y, lambda _, c: c[x], p, plain_step, steps).items() if p else ():
        rank = int(np.linalg.matrix_rank(s.gram / np.outer(d := np.sqrt(np.maximum(np.diag(s.gram), 1e-300)), d), tol=1e-9))
        dispersion = s.pearson / max(s.n - rank, 1)
        cov = dispersion * np.linalg.pinv(s.gram, rcond=1e-12, hermitian=True)
        out.append((*k, status, int(s.n), s.total, took, dispersion, beta.tolist(), cov.ravel(order="F").tolist()))
    return ready.sparkSession.createDataFrame(out, schema)


# A penalised baseline: cyclic season, smooth trend, weekdays


def cubic(t: np.ndarray, count: int, cyclic: bool) -> np.ndarray:
    """Uniform cubic B-splines at t in [0, 1]: ``count`` functions, whose ends meet if cyclic."""
    pieces = count if cyclic else count - 3
    at = np.clip(t, 0.0, 1.0) * pieces
    cell = np.minimum(np.floor(at), pieces - 1).astype(int)
    f = at - cell
    weights = np.stack([(1 - f) ** 3, 3 * f**3 - 6 * f**2 + 4, -3 * f**3 + 3 * f**2 + 3 * f + 1, f**3], axis=1) / 6
    out = np.zeros((len(t), count))
    for j in range(4):
        np.add.at(out, (np.arange(len(t)), (cell + j) % count), weights[:, j])
    return out


def contrast(count: int) -> np.ndarray:
    """An orthonormal basis of the coefficients that sum to zero."""
    return np.linalg.qr(np.column_stack([np.ones(count), np.eye(count)[:, 1:]]))[0][:, 1:]


def roughness(count: int, cyclic: bool) -> np.ndarray:
    """Squared second differences of coefficients, as a matrix."""
    d = np.diff(np.eye(count), 2, axis=0)
    if cyclic:
        d = np.eye(count) - 2 * np.roll(np.eye(count), 1, axis=1) + np.roll(np.eye(count), 2, axis=1)
    return d.T @ d


@dataclass
class Smooth:
    """A baseline's design: intercept, season (cyclic), trend, weekdays; and the penalties on season and trend."""

    first: int
    last: int
    season: int
    trend: int

    @property
    def sizes(self) -> list[int]:
        return [1, self.season - 1, self.trend - 1, 6]

    def rows(self, day: np.ndarray, doy: np.ndarray) -> np.ndarray:
        """``day`` counts from 1970-01-01, ``doy`` is the day of the year."""
        day = day.astype(float)
        season = cubic(((doy - 1) / 365.25) % 1.0, self.season, True) @ contrast(self.season)
        trend = cubic((day - self.first) / max(self.last - self.first, 1), self.trend, False) @ contrast(self.trend)
        return np.hstack([np.ones((len(day), 1)), season, trend, np.eye(7)[((day.astype(int) + 3) % 7)][:, 1:]])

    def penalties(self) -> list[tuple[np.ndarray, int]]:
        """(matrix, rank) of each smooth term, in the place of its coefficients."""
        p, at, out = sum(self.sizes), 1, []
        for count, cyclic in ((self.season, True), (self.trend, False)):
            z = contrast(count)
            whole = np.zeros((p, p))
            whole[at : at + count - 1, at : at + count - 1] = z.T @ roughness(count, cyclic) @ z
            out.append((whole, count - 1 if cyclic else count - 2))
            at += count - 1
        return out


def smoothing(s: Sums, penalties: list[tuple[np.ndarray, int]], start: np.ndarray | None = None, steps: int = 500, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float, float, bool]:
    """(log of the penalties' weights, coefficients, effective degrees of freedom, scale, settled) by restricted maximum likelihood.

    The working model's likelihood needs only the sums. Each step sets a weight to scale * (rank - weight * tr(A S)) / (b'S b)
    with A the inverse of X'WX + penalties (the generalised Fellner-Schall step), which never lowers the restricted likelihood.
    """
    log = np.zeros(len(penalties)) if start is None else start.copy()
    for _ in range(steps):
        a = np.linalg.inv(s.gram + sum(math.exp(v) * m for v, (m, _) in zip(log, penalties)))
        beta = a @ s.rhs
        edf = float(np.trace(a @ s.gram))
        scale = float(s.zz - 2 * beta @ s.rhs + beta @ s.gram @ beta) / max(s.n - edf, 1.0)
        new = np.array([math.log(max(scale * (rank - math.exp(v) * np.trace(a @ m)), 1e-12)) - math.log(max(float(beta @ m @ beta), 1e-12)) for v, (m, rank) in zip(log, penalties)])
        new = np.clip(new, log - 5, log + 5).clip(-20, 25)
        moved = np.abs(new - log).max()
        log = new
        if moved < tolerance:
            break
    return log, beta, edf, scale, bool(moved < tolerance)


def _fit_baseline(fitted: DataFrame, deaths: str, season: int, trend: int | None, steps: int) -> tuple[Smooth, np.ndarray, dict] | None:
    """The model, its coefficients and what was fitted, from rows (_day, _doy, counts); None without events."""
    span = fitted.agg(F.min("_day").alias("a"), F.max("_day").alias("b"), F.count_distinct(F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day").cast("int")))).alias("years"), F.sum(deaths).alias("total"), F.avg(deaths).cast("double").alias("mean")).first()
    if not span["total"]:
        return None
    model = Smooth(int(span["a"]), int(span["b"]), season, trend or max(10, 2 * span["years"]))
    penalties, chosen = model.penalties(), {}

    def solve(key: tuple, s: Sums) -> np.ndarray:
        log, beta, edf, scale, ok = smoothing(s, penalties, chosen.get("log"))
        chosen.update({"log": log, "edf": edf, "scale": scale, "ok": ok})
        return beta

    # the weights move with the steps, so the fit has settled when the coefficients have
    betas, last, status = None, None, "not settled"
    for step in range(steps):
        s = summed(fitted, (), ["_day", "_doy"], deaths, lambda _, c: model.rows(c["_day"], c["_doy"]), sum(model.sizes), betas)[()]
        beta = solve((), s)
        if last is not None and np.abs(beta - last).max() < 1e-8 * (1 + np.abs(beta).max()) and chosen["ok"]:
            status = "success"
            break
        last, betas = beta, {(): beta}
    null = fitted.agg(F.sum(2 * (F.when(F.col(deaths) > 0, F.col(deaths) * F.log(F.col(deaths) / span["mean"])).otherwise(0.0) - (F.col(deaths) - span["mean"]))).alias("d")).first()["d"]
    about = {"status": status, "n_steps": step + 1, "edf": chosen["edf"], "scale": chosen["scale"], "weights": np.exp(chosen["log"]).tolist(), "deviance_explained": 1 - s.deviance / null if null else 0.0, "coef": beta.tolist()}
    return model, beta, about


def penalised_baseline(series: DataFrame, deaths: str = "deaths", date: str = "date", season: int = 10, trend: int | None = None, steps: int = 60, out: str = "expected") -> tuple[DataFrame, dict]:
    """Add the expected count of a smooth baseline without exposure; and what was fitted.

    Quasi-Poisson regression on a cyclic cubic spline of the day of the year (``season`` functions), a cubic spline of time (``trend``
    functions; by default two a year, ten at least), and weekdays. Second differences of both are penalised; the weights of the penalties
    are chosen by restricted maximum likelihood at every Newton step, from the same sums. Returned are status (success or not settled), edf,
    scale, the penalties' weights, deviance_explained, coef. The intercept is not penalised, so observed and expected sums agree.
    Rows without a count are predicted, not fitted. A series without any counts gets null.
    """
    ready = series.withColumns({"_day": F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double"), "_doy": F.dayofyear(date).cast("double")})
    fitted = ready.filter(F.col(deaths).isNotNull() & F.col("_day").isNotNull()).select("_day", "_doy", deaths).persist()
    try:
        found = _fit_baseline(fitted, deaths, season, trend, steps)
    finally:
        fitted.unpersist()
    if found is None:
        return series.withColumn(out, F.lit(None).cast("double")), {"status": "no events"}
    model, beta, about = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day, doy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_day", "_doy"))
            known = ~np.isnan(day.astype(float))
            mu = np.full(len(batch), np.nan)
            mu[known] = np.exp(model.rows(day[known], doy[known]) @ beta)
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("_day", "_doy", out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(mu, mask=~known)], [*(batch.schema.names[i] for i in kept), out])

    schema = T.StructType([f for f in series.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])
    return ready.mapInArrow(run, schema), about
