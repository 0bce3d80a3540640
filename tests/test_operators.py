"""Edge cases, invariants and known answers of the panel operators."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.functions import parse, stats
from epispark.functions.splines import NaturalSpline, lag_basis
from epispark.operators import burden, dlnm, geo, matched, pooling, quality
from epispark.operators import panel as P
from epispark.operators import timeseries as ts
from epispark.sources import io


def test_dates_edge(spark):
    df = spark.createDataFrame([("1042022",), ("21042022",), ("2021-03-23",), ("32132020",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(parse.parse_date("s")).collect()]
    assert got == [dt.date(2022, 4, 1), dt.date(2022, 4, 21), dt.date(2021, 3, 23), None, None, None]


def test_ages_edge(spark):
    df = spark.createDataFrame([("465",), ("505",), ("399",), ("250",), ("150",), ("65",), ("4x5",), ("0,",), (None,)], "s string")
    got = {v: [r[0] for r in df.select(parse.decode_age("s", v)).collect()] for v in "ABCDE"}
    assert got["A"] == [65, 105, 0, 0, 0, 0, None, None, None]
    assert got["B"] == [65, 105, 0, 0, 150, 65, None, None, None]
    assert got["C"] == [65, 105, None, None, 150, 65, None, None, None]
    assert got["D"] == [65, 505, 399, 250, 150, 65, None, None, None]
    assert got["E"] == [65, 105, None, None, None, None, None, None, None]


def test_easter(spark):
    years = spark.createDataFrame([(1995,), (2000,), (2011,), (2024,)], "year int")
    got = [r[0] for r in years.select(parse.easter(F.col("year"))).collect()]
    assert got == [dt.date(1995, 4, 16), dt.date(2000, 4, 23), dt.date(2011, 4, 24), dt.date(2024, 3, 31)]


def _series(spark, values, region="a"):
    return spark.createDataFrame([(region, dt.date(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)], "region string, date date, v double")


def test_runs_edge(spark):
    df = _series(spark, [9.0, 9.0, 9.0, 1.0, 9.0, 5.0, 9.0, 9.0], "a").unionByName(_series(spark, [9.0, 9.0, 9.0, 9.0], "b"))
    got = [(r.region, r.run_length, r.in_run) for r in ts.runs(df, F.col("v") > 5, ["region"]).orderBy("region", "date").collect()]
    assert [g[1] for g in got] == [3, 3, 3, 0, 1, 0, 2, 2, 4, 4, 4, 4]
    assert [g[2] for g in got] == [1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_gaps_edge(spark):
    short = _series(spark, [None, 1.0] + [None] * 14 + [16.0, None], "a")
    long = _series(spark, [0.0] + [None] * 15 + [16.0], "b")
    empty = _series(spark, [None, None], "c")
    out = ts.fill_gaps(short.unionByName(long).unionByName(empty), "v", ["region"]).orderBy("region", "date").collect()
    a = [r.v for r in out if r.region == "a"]
    assert a[0] is None and a[-1] is None and a[1:17] == pytest.approx([float(i) for i in range(1, 17)])
    assert [r.v for r in out if r.region == "b"][1:-1] == [None] * 15
    assert [r.v for r in out if r.region == "c"] == [None, None]


def test_dense_panel_makes_row_lags_calendar_lags(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1), ("a", dt.date(2020, 1, 3), 2), ("b", dt.date(2020, 1, 2), 5)], "region string, date date, deaths int")
    dense = P.densify(df, fill=["deaths"])
    assert dense.count() == 6
    rows = ts.lag_matrix(dense, "deaths", 2, ["region"]).select("region", "date", "lag1", "lag2").exceptAll(ts.calendar_lags(dense, "deaths", 2, ["region"]).select("region", "date", "lag1", "lag2"))
    assert rows.count() == 0


def test_curve_edge(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (0.25,), (1.0,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(burden.interpolate(F.col("x"), 0.0, 0.5, [1.0, 2.0, 4.0])).collect()]
    assert got == [1.0, 1.0, 1.5, 4.0, 4.0, None]


def test_matched_sets_need_two_controls(spark):
    days = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(3)] + [dt.date(2020, 2, 4), dt.date(2020, 2, 11)]
    cases = spark.createDataFrame([(1, days[0]), (2, days[3])], "case_id long, date date")
    sets = matched.matched_sets(cases, spark.createDataFrame([(d,) for d in days], "date date"), "case_id").collect()
    assert {r.case_id for r in sets} == {1} and len(sets) == 3 and sum(r.is_case for r in sets) == 1


def test_spline_expressions_equal_numpy(spark):
    s = NaturalSpline((0.0, 40.0), (10.0, 22.0, 30.0))
    x = np.linspace(-5, 45, 41)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(F.array(*s.columns(F.col("x")))).collect()])
    assert np.allclose(got, s.basis(x), atol=1e-9)
    outside = s.basis(np.array([41.0, 42.0, 43.0]))
    assert np.allclose(outside[2] - outside[1], outside[1] - outside[0])


def test_cross_basis_equals_numpy(spark):
    s, lags = NaturalSpline((0.0, 40.0), (15.0, 25.0)), 4
    x = [10.0, 30.0, 22.0, 5.0, 38.0, 19.0, 27.0]
    rows = dlnm.cross_basis(_series(spark, x).withColumnRenamed("v", "exposure"), "exposure", s, lags, 3).orderBy("date").collect()
    assert all(r.cb is None for r in rows[:lags])
    c = lag_basis(lags, 3).basis(np.arange(lags + 1))
    b = s.basis(np.array(x))
    for t in range(lags, len(x)):
        want = sum(np.outer(b[t - k], c[k]) for k in range(lags + 1)).ravel()
        assert np.allclose(rows[t].cb, want)


def test_poisson_fit_balances_and_recovers():
    rng = np.random.default_rng(42)
    x = np.column_stack([np.ones(1500), rng.normal(size=1500), rng.normal(size=1500)])
    y = rng.poisson(np.exp(x @ np.array([1.0, 0.3, -0.2]))).astype(float)
    beta, cov, dispersion, kept, settled = dlnm.fit_quasi_poisson(np.column_stack([x, x[:, 1] * 2]), y)
    assert list(kept) == [0, 1, 2] and np.allclose(beta, [1.0, 0.3, -0.2], atol=0.08)
    assert abs((y - np.exp(x @ beta)).sum()) < 1e-4 and 0.8 < dispersion < 1.2


def test_region_fits_have_a_status(spark):
    rng = np.random.default_rng(1)
    rows = []
    for region, n, level in (("good", 800, 5.0), ("short", 200, 5.0), ("zero", 500, 0.0)):
        x = 20 + 8 * np.sin(np.arange(n) / 58) + rng.normal(0, 3, n)
        y = rng.poisson(level * np.exp(0.01 * np.maximum(x - 20, 0))) if level else np.zeros(n)
        rows += [(region, dt.date(2015, 1, 1) + dt.timedelta(i), float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "region string, date date, exposure double, deaths long")
    s = NaturalSpline((0.0, 40.0), (15.0, 20.0, 26.0))
    fits = {r.region: r for r in dlnm.fit_regions(dlnm.cross_basis(df, "exposure", s, 7, 3), s, lags=7, lag_df=3, df_per_year=2).collect()}
    assert {k: v.status for k, v in fits.items()} == {"good": "success", "short": "skip", "zero": "error"}
    good = spark.createDataFrame([(fits["good"].coef, fits["good"].vcov, fits["good"].mmt, fits["good"].p99)], "coef array<double>, vcov array<double>, mmt double, p99 double")
    at = dlnm.predict_rr(good, s, F.array("mmt", "p99"), F.col("mmt"), 7, 3).orderBy("rr").collect()
    assert at[0].rr == pytest.approx(1.0) and at[1].rr == pytest.approx(fits["good"].rr_p99) and at[1].rr_hi == pytest.approx(fits["good"].rr_p99_hi)


def test_pooling_known_answers(spark):
    df = spark.createDataFrame([("g", 0.1, 0.01), ("g", 0.3, 0.04), ("g", 0.7, 0.02), ("one", 0.5, 0.1)], "k string, y double, v double")
    got = {r.k2: r for r in pooling.pool(df.withColumnRenamed("k", "k2"), ["k2"]).collect()}
    w = np.array([100, 25, 50.0])
    y = np.array([0.1, 0.3, 0.7])
    fixed = (w * y).sum() / w.sum()
    q = (w * (y - fixed) ** 2).sum()
    tau2 = max(0, (q - 2) / (w.sum() - (w * w).sum() / w.sum()))
    g = got["g"]
    assert g.fixed == pytest.approx(fixed) and g.q == pytest.approx(q) and g.tau2 == pytest.approx(tau2)
    assert got["one"].fixed == pytest.approx(0.5) and got["one"].random == pytest.approx(0.5)
    b, _, t, done = pooling.reml(y, 1 / w)
    assert t >= 0 and 0.1 < b[0] < 0.7
    mean, cov, psi, settled = pooling.multivariate_reml(y[:, None], (1 / w)[:, None, None])
    assert done and settled and mean[0] == pytest.approx(b[0], abs=1e-3) and psi[0, 0] == pytest.approx(t, abs=1e-3)


def test_chi_square_tail():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(0, 5) == 1.0


def test_conditional_logit_equals_expanded_sets(spark):
    rng = np.random.default_rng(3)
    days = [(dt.date(2020, 1, 1) + dt.timedelta(i)) for i in range(200)]
    x = rng.normal(20, 5, 200)
    n = rng.poisson(np.exp(0.5 + 0.05 * (x - 20)))
    df = spark.createDataFrame([(d, float(a), int(b)) for d, a, b in zip(days, x, n)], "date date, x double, n long")
    fit = matched.conditional_logit(matched.stratum_counts(df, "n", ["x"]), ["x"])
    groups = {}
    for d, a, b in zip(days, x, n):
        groups.setdefault((d.year, d.month, d.weekday()), []).append((a, b))
    beta = 0.0
    for _ in range(20):
        g = h = 0.0
        for rows in groups.values():
            if len(rows) < 3:
                continue
            a, b = np.array(rows).T
            w = np.exp(beta * (a - 20))
            w = w / w.sum()
            m = (w * a).sum()
            g += (b * a).sum() - b.sum() * m
            h += b.sum() * ((w * a * a).sum() - m * m)
        beta += g / h
    assert fit["beta"][0] == pytest.approx(beta, abs=1e-6) and fit["se"][0] == pytest.approx(1 / math.sqrt(h), rel=1e-4)


def test_burden_adds_up(spark):
    rng = np.random.default_rng(2)
    rows = [(r, dt.date(2019 + i // 300, 1, 1) + dt.timedelta(i % 300), float(x), int(rng.poisson(4))) for r in "ab" for i, x in enumerate(rng.normal(25, 8, 600))]
    df = spark.createDataFrame(rows, "region string, date date, exposure double, deaths long")
    cuts = {"p1": 0.01, "p2_5": 0.025, "p97_5": 0.975, "p99": 0.99}
    flagged = ts.extreme_flags(ts.attach_quantiles(df, "exposure", cuts, ["region"]), "exposure", 22.0)
    an = burden.attributable(flagged, burden.interpolate(F.col("exposure"), 0.0, 1.0, [1 + 0.001 * (i - 22) ** 2 for i in range(60)]))
    total = burden.burden_sums(an, []).first()
    by_region = burden.burden_sums(an, ["region"]).agg(F.sum("total_an")).first()[0]
    by_year = burden.burden_sums(an.withColumn("year", F.year("date")), ["year"]).agg(F.sum("total_an")).first()[0]
    assert total.total_an == pytest.approx(by_region) and total.total_an == pytest.approx(by_year) and total.total_an > 0
    coef = np.array([0.1, 0.05, 0.02, 0.01])
    spline = NaturalSpline((0.0, 50.0), (15.0, 25.0, 35.0))
    certain = burden.monte_carlo(df, coef, np.zeros((4, 4)), spline, 22.0, {"p1": 5, "p2_5": 8, "p97_5": 40, "p99": 45}, draws=3, digits=6)
    log_rr = (spline.basis(np.array([r[2] for r in rows])) - spline.basis(np.array([22.0]))) @ coef
    want = (np.where(log_rr > 0, 1 - np.exp(-log_rr), 0) * np.array([r[3] for r in rows]))[np.array([r[2] for r in rows]) != 22].sum()
    assert [r.total_an for r in certain.collect()] == pytest.approx([want] * 3, rel=1e-6)


def test_life_table_golden_value(spark):
    """Remaining life expectancy by interpolation between whole ages, clamped at the ends."""
    table = spark.createDataFrame([(60, 23.0), (61, 22.0), (62, 21.5)], "age int, ex_mean double")
    got = burden.interpolate_table(spark.createDataFrame([(59.0,), (60.5,), (61.0,), (99.0,)], "a double"), "a", table, "age", "ex_mean", "ex").orderBy("a").collect()
    assert [r.ex for r in got] == [23.0, 22.5, 22.0, 21.5]


def test_event_csv_dialects(spark, tmp_path):
    (tmp_path / "DO20OPEN.csv").write_text('DTOBITO;CODMUNRES;IDADE;SEXO;CAUSABAS\n"01012020";"110001";"465";"1";"I21"\n')
    (tmp_path / "DO21OPEN.csv").write_text("CAUSABAS,DTOBITO,CODMUNRES,IDADE,SEXO\nJ18,2021-03-02,1100015,480,Feminino\n")
    df = io.read_event_csv(spark, [str(tmp_path / "*.csv")])
    got = {r.source_file: (r.DTOBITO, r.CODMUNRES, r.CAUSABAS) for r in df.collect()}
    assert got == {"DO20OPEN.csv": ("01012020", "110001", "I21"), "DO21OPEN.csv": ("2021-03-02", "1100015", "J18")}
    kinds = {r.path[-12:]: (r.separator, r.date_format, r.sex_format) for r in io.detect_dialects(spark, [str(tmp_path / "*.csv")]).collect()}
    assert kinds == {"DO20OPEN.csv": (";", "ddmmyyyy", "numeric"), "DO21OPEN.csv": (",", "iso", "text")}
    years = {r[0] for r in df.select(io.year_from_name(pattern="DO([0-9]{2})")).collect()}
    assert years == {2020, 2021}


def test_heads_bound_what_is_read(spark, tmp_path):
    import gzip

    big = tmp_path / "DO22OPEN.csv"
    with open(big, "w") as f:
        f.write("DTOBITO;SEXO\n")
        for _ in range(200_000):
            f.write("2022-05-01;Masculino\n")
    (tmp_path / "DO23OPEN.csv.gz").write_bytes(gzip.compress(b"SEXO,DTOBITO\r\n2,05012023\r\n"))
    (tmp_path / "DO24OPEN.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("a;b;c\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "DO25OPEN.csv").write_bytes("SEXO;DTOBITO;MUNICÍPIO\n1;01012025;São\n".encode("latin-1"))
    files = io.list_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["DO22OPEN.csv", "DO23OPEN.csv.gz", "DO24OPEN.csv", "DO25OPEN.csv"]
    heads = io.read_heads(spark, files)
    assert [len(heads[f]) for f in files] == [io.HEAD, 26, 0, 38] and os.path.getsize(big) > 4_000_000
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getStatistics("file", spark._jvm.org.apache.hadoop.fs.Path(files[0]).getFileSystem(spark._jsc.hadoopConfiguration()).getClass())
    before = stats.getBytesRead()
    kinds = {r.path.rsplit("/", 1)[1]: (r.separator, r.date_format, r.sex_format) for r in io.detect_dialects(spark, str(tmp_path)).collect()}
    assert stats.getBytesRead() - before <= 4 * io.HEAD
    assert kinds == {"DO22OPEN.csv": (";", "iso", "text"), "DO23OPEN.csv.gz": (",", "ddmmyyyy", "numeric"), "DO24OPEN.csv": (",", "ddmmyyyy", "numeric"), "DO25OPEN.csv": (";", "ddmmyyyy", "numeric")}
    got = io.read_event_csv(spark, files, ["DTOBITO", "SEXO", "MUNICÍPIO"]).groupBy("source_file", "DTOBITO", "SEXO", "MUNICÍPIO").count().collect()
    assert {tuple(r) for r in got} == {("DO22OPEN.csv", "2022-05-01", "Masculino", None, 200_000), ("DO23OPEN.csv.gz", "05012023", "2", None, 1), ("DO25OPEN.csv", "01012025", "1", "São", 1)}
    assert io.read_event_csv(spark, str(tmp_path / "DO24*")).count() == 0


def test_upsert_touches_only_what_changed(spark, tmp_path):
    path, schema = f"{tmp_path}/d", "source string, year int, region int, n int"
    first = spark.createDataFrame([("01", 2000, r, 1) for r in range(5)] * 2 + [("b", 2000, 1, 7), ("b", 2001, 1, 8), (None, 2001, 1, 5), ("b", None, 1, 6)], schema)
    apply = lambda df: {(r.source, r.year): r.changed for r in io.upsert(df, path, ["year", "region"], ["n"]).collect()}
    total = lambda: {(r.year, r.region): r.n for r in io.read_upserted(spark, path, ["year", "region"], ["n"]).collect()}
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_manifest" not in d}
    assert set(apply(first).values()) == {True} and len(apply(first)) == 5
    want = {(2000, r): 2 + 7 * (r == 1) for r in range(5)} | {(2001, 1): 13, (None, 1): 6}
    assert total() == want
    before = files()
    assert set(apply(first).values()) == {False} and files() == before and total() == want  # twice is once
    second = spark.createDataFrame([("b", 2001, 1, 9), ("b", 2001, 2, 1), ("c", 2002, 1, 4), ("b", 2000, 1, 7)], schema)
    assert apply(second) == {("b", 2001): True, ("c", 2002): True, ("b", 2000): False}
    after = files()
    gone = {f for f in before if f not in after}
    assert gone and all("source=b" in f and "year=2001" in f for f in gone) and all(after[f] == t for f, t in before.items() if f in after)
    want |= {(2001, 1): 14, (2001, 2): 1, (2002, 1): 4}
    assert total() == want
    # data without its entry in the manifest, as an attempt that died leaves it, is written again
    newest = max((os.path.join(d, f) for d, _, names in os.walk(f"{path}/_manifest") for f in names if f.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
    os.remove(newest)
    assert apply(second)[("b", 2001)] and total() == want
    renamed = io.upsert(second.withColumnRenamed("n", "cases"), path, ["year", "region"], ["n"], {"cases": "n"})
    assert not renamed.filter("changed").count() and io.upsert(first.limit(0), path, ["year", "region"], ["n"]).count() == 0 and total() == want


def test_sinks_and_optional_sources(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.123456789), ("a", 1, 1.0)], "region_code string, date int, v double")
    io.write_panel(df, str(tmp_path / "p"))
    io.write_csv(df, str(tmp_path / "c"))
    io.write_json_report(df, str(tmp_path / "j"), digits=3)
    io.write_sample(df, str(tmp_path / "s"), ["region_code"], 1)
    assert io.optional_parquet(spark, str(tmp_path / "none")) is None
    assert io.optional_parquet(spark, str(tmp_path / "p")).count() == 2
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().region_code == "a"
    assert {r.v for r in io.read_json_report(spark, str(tmp_path / "j") + "/*.json", "v double").collect()} <= {0.123, 1.0}


def test_gates(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(ValueError):
        quality.require_match_rate(df, F.col("x").isNotNull())
    with pytest.raises(ValueError):
        quality.require_columns(df, ["y"])
    assert quality.require_match_rate(df.filter("x = 1"), F.col("x").isNotNull()) == "ok"
    assert quality.require_match_rate(df.filter("x = 5"), F.col("x").isNotNull()) == "empty"


def test_model_queries_do_the_whole_job(spark):
    """The grid varies exposure df, horizons reach 35 days and share the longest fit's minimum, five percentiles."""
    from unittest import mock

    from epispark.plans import registry

    rng = np.random.default_rng(5)
    rows = []
    for region in (*"abcdefghijk", "short"):
        for i in range(120 if region == "short" else 800):
            t = 25 + 8 * np.sin(i / 58) + rng.normal(0, 3)
            rows.append((region, dt.date(2000, 1, 1) + dt.timedelta(i), float(rng.poisson(60 * np.exp(0.002 * (t - 24) ** 2))), float(t)))
    df = spark.createDataFrame(rows, "region string, date date, deaths double, exposure double").cache()
    few = df.filter("region in ('a', 'b', 'c', 'short')")
    with mock.patch.object(registry, "panel", lambda spark, sf: few), mock.patch.object(registry, "nation_panel", lambda spark, sf: df):
        grid = registry.sensitivity_grid(spark, "").collect()
        fits = registry.harvesting_fits(spark, "").collect()
        burden_rows = registry.monte_carlo_burden(spark, "").collect()
    good = [r for r in grid if r.region == "a"]
    assert {(r.lags, r.exposure_df, r.lag_df) for r in good} == {(n, 4, 4) for n in (7, 14, 21, 28)} | {(21, e, k) for e in (3, 4, 5) for k in (3, 4, 5)}
    assert len(good) == 13 and all(r.status == "success" and r.rr_p5 > 0 and r.rr_p50 > 0 and r.rr_p95 > 0 for r in good)
    assert {r.status for r in grid + fits if r.region == "short"} == {"skip"}
    for region in "abc":
        horizons = {r.lags: r for r in fits if r.region == region}
        assert set(horizons) == {7, 14, 21, 28, 35} and len({r.mmt for r in horizons.values()}) == 1
        assert horizons[35].rr_p50 >= 1 - 1e-6 and horizons[7].err_long == pytest.approx(horizons[35].rr_p99 - 1)
    assert burden_rows


def test_nearest_points_far_dense_and_tied(spark):
    rnd = __import__("random").Random(4)
    points = [(i, rnd.gauss(0, 0.001), rnd.gauss(0, 0.001)) for i in range(900)] + [(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(900, 1000)]
    points += [(2000, 7.0, 7.0), (1999, 7.0, 7.0), (3000, None, 1.0), (3001, float("nan"), 1.0)]
    queries = [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(200)] + [(i, rnd.gauss(0, 0.001), rnd.gauss(0, 0.001)) for i in range(200, 400)]
    queries += [(400, 1e7, -1e7), (401, 7.0, 7.0), (402, None, 0.0)]
    q = spark.createDataFrame(queries, "qid long, lon double, lat double")
    p = spark.createDataFrame(points, "pid long, lon double, lat double")
    got = {r.qid: (r.pid, r.distance) for r in geo.nearest_join(q, p, "qid", "pid").collect()}
    usable = [x for x in points if x[1] is not None and x[1] == x[1]]
    assert set(got) == set(range(402))  # however far a query is, it has an answer
    for i, x, y in queries[:402]:
        d, best = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in usable)
        assert got[i][0] == best and got[i][1] == pytest.approx(math.sqrt(d))
    assert geo.nearest_join(q, p.limit(0), "qid", "pid").count() == 0
    one = geo.nearest_join(q, p.filter("pid = 5"), "qid", "pid").collect()
    assert len(one) == 402 and {r.pid for r in one} == {5}


def test_histories_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X;Y\n1;2\n")
    (tmp_path / "b.csv").write_text("Y;X;Z\n4;3;5\n")
    spark.createDataFrame([(6, 7)], "X int, W int").write.parquet(f"{tmp_path}/c.parquet")
    paths = [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv", f"{tmp_path}/missing.csv"]
    got = io.read_history(spark, io.existing_paths(spark, paths), [f"{tmp_path}/c.parquet"])
    assert sorted((r.X, r.Y, r.Z, r.W) for r in got.collect()) == [("1", "2", None, None), ("3", "4", "5", None), ("6", None, None, "7")]


def test_sinks_can_be_read_back(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.23456789, [0.1111], (0.2222, "a")), (1, 2.0, [], None)], "k int, x double, a array<double>, s struct<y: double, z: string>")
    io.write_json_report(df, f"{tmp_path}/j", digits=2)
    got = {r.k: r for r in spark.read.schema(df.schema).json(f"{tmp_path}/j").collect()}
    assert (got[2].x, got[2].a, got[2].s.y, got[2].s.z) == (1.23, [0.11], 0.22, "a") and got[1].a == [] and got[1].s is None
    io.write_csv(df.select("k", "x"), f"{tmp_path}/c")
    assert sorted(tuple(r) for r in io.read_covariates(spark, f"{tmp_path}/c", "k int, x double").collect()) == [(1, 2.0), (2, 1.23456789)]
    panel = spark.range(200).selectExpr("cast(id % 20 as int) as region_code", "date_add(date'2001-01-01', cast(id as int)) as date")
    io.write_panel(panel.repartition(7), f"{tmp_path}/p")
    seen = {}
    for part in sorted((tmp_path / "p").glob("part-*")):
        rows = [tuple(r) for r in spark.read.parquet(str(part)).collect()]
        assert rows == sorted(rows)
        for region in {r[0] for r in rows}:
            assert seen.setdefault(region, part) == part  # ranges: a region is in one file
    assert len(seen) == 20


def test_conditional_estimates_settle_or_fail(spark):
    days = [(f"s{k % 3}", float(k % 2), float(k % 2)) for k in range(30)]  # cases only where x is 1: no finite estimate
    df = spark.createDataFrame(days, "stratum string, n double, x double")
    with pytest.raises((ValueError, np.linalg.LinAlgError)):
        matched.conditional_logit(df, ["x"], steps=8)


def test_rates_and_attributes_without_a_match(spark):
    sums = spark.createDataFrame([(1, 10.0, 5.0), (2, 8.0, 2.0)], "region int, annual_heat_an double, annual_cold_an double")
    got = {r.region: r for r in burden.burden_rates(sums, spark.createDataFrame([(1, 1000)], "region int, population int"), ["region"]).collect()}
    assert (got[1].heat_rate, got[1].cold_rate, got[1].total_rate) == (1000, 500, 1500) and got[2].heat_rate is None
    units = spark.createDataFrame([("a", "X"), ("b", "Y")], "unit string, state string")
    out = {r.unit: r.v for r in P.attach_attributes(units, spark.createDataFrame([("X", 3)], "code string, v int"), "state", "code").collect()}
    assert out == {"a": 3, "b": None}


def test_burden_draws_use_exact_exposures(spark):
    spline = NaturalSpline((0.0, 10.0), (5.0,))
    panel = spark.createDataFrame([(4.96, 3), (5.04, 2), (9.99, 1), (None, 5)], "exposure double, deaths int")
    coef = np.array([0.3, 0.2])[: spline.df]
    draws = burden.monte_carlo(panel, coef, np.zeros((spline.df, spline.df)), spline, 5.0, {"p1": 1.0, "p2_5": 2.0, "p97_5": 8.0, "p99": 9.0}, draws=3).collect()
    log_rr = (spline.basis(np.array([4.96, 5.04, 9.99])) - spline.basis(np.array([5.0]))) @ coef
    an = np.where(log_rr > 0, 1 - np.exp(-log_rr), 0) * [3, 2, 1]
    for r in draws:
        assert r.heat_an == pytest.approx(an[1:].sum()) and r.cold_an == pytest.approx(an[0]) and r.extreme_heat_an == pytest.approx(an[2])


def test_nearest_points_meet_few_pairs_however_spread(spark):
    rng = np.random.default_rng(11)
    unit = rng.random((3000, 2))
    spreads = [
        np.vstack([unit, 10.0 ** np.arange(-12, 12)[:, None] * [1, 1]]),  # outliers at all scales
        np.vstack([np.column_stack([np.zeros(2900), unit[:2900, 1]]), unit[:100] * 50]),  # most in one column
    ]
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((500, 2)))], "qid int, x double, y double")
    for points in spreads:
        p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "p int, px double, py double")
        placed, depth = geo.split_tree(p, 16)
        assert placed.groupBy(f"node_{depth}").count().agg(F.max("count")).first()[0] <= 16
        met = geo.candidates(q.select("x", "y"), placed, depth).toPandas()
        assert len(met) <= 500 * 80  # of 500 * 3000
        best = (np.hypot(met.x - met.px, met.y - met.py)).groupby([met.x, met.y]).min()
        for r in q.collect():
            assert best[(r.x, r.y)] == pytest.approx(np.hypot(points[:, 0] - r.x, points[:, 1] - r.y).min())


def test_curves_by_group(spark):
    rng = np.random.default_rng(12)
    knots = {"a": np.sort(rng.normal(0, 5, 40)), "b": np.array([1.0, 2.0, 10.0]), "one": np.array([3.0])}
    values = {k: rng.normal(1, 0.2, len(v)) for k, v in knots.items()}
    curves = [(k, float(x), float(y)) for k in knots for x, y in zip(knots[k], values[k])] + [("b", 2.0, float(values["b"][1])), ("b", None, 9.0), ("b", float("nan"), 9.0), ("b", 3.0, None)]
    curves = spark.createDataFrame(curves, "g string, at double, rr double")
    rows = [(i, ["a", "a", "a", "b", "one", "none", None][i % 7], float(x), "clash") for i, x in enumerate(rng.normal(0, 8, 700))]
    rows += [(900, "a", None, "x"), (901, "a", float("nan"), "x"), (902, "b", 1.0, "x"), (903, "b", 10.0, "x"), (904, "b", 6.0, "x"), (905, "b", float("inf"), "x"), (906, "b", float("-inf"), "x")]
    df = spark.createDataFrame(rows + rows[:3], "i int, g string, x double, rr string")
    linear = burden.curve_lookup(df, "x", curves, ["g"])
    assert linear.columns == ["i", "g", "x", "rr"] and linear.count() == len(rows) + 3
    got = {r.i: r.rr for r in linear.collect()}
    near = {r.i: r.rr for r in burden.curve_lookup(df, "x", curves, ["g"], how="nearest").collect()}
    for i, g, x, _ in rows:
        if g not in knots or x is None or x != x:
            assert got[i] is None and near[i] is None
        else:
            assert got[i] == pytest.approx(np.interp(x, knots[g], values[g]), abs=1e-12)
            away = np.abs(knots[g] - min(max(x, -1e9), 1e9))
            assert near[i] == values[g][away.argmin()]
    assert near[904] == values["b"][1]  # a tie: the lower knot
    with pytest.raises(ValueError):
        burden.curve_lookup(df, "x", curves, ["g"], how="cubic")


def test_nearest_points_at_one_place_are_one(spark):
    p = spark.createDataFrame([(i, 2.0, 3.0) for i in range(5, 2000)] + [(1, 9.0, 9.0), (2, float("nan"), 1.0), (3, None, 1.0), (4, float("inf"), 1.0)], "pid int, lon double, lat double")
    q = spark.createDataFrame([(i, 0.0, 0.0) for i in range(1000)] + [(-1, 10.0, 10.0), (-1, 0.0, 0.0), (-2, None, 0.0)], "qid int, lon double, lat double")
    got = geo.nearest_join(q, p, "qid", "pid").collect()
    assert len(got) == 1002 and {(r.pid, round(r.distance, 6)) for r in got} == {(5, 3.605551), (1, 1.414214)}


def test_selected_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 500), np.full(300, 0.25), 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    probabilities = [0.0, 0.01, 0.4, 0.5, 0.77, 1.0]
    for most in (0, 20, 100_000):
        assert stats.selected_quantiles(df, "x", probabilities, most=most) == pytest.approx(np.quantile(x, probabilities).tolist())
    assert stats.selected_quantiles(df.limit(0), "x", [0.5]) == [None]
    assert stats.quantiles(df.limit(0), "x", [0.5]).first()["q"] is None


def test_selected_quantiles_with_infinities_and_by_columns(spark):
    inf = float("inf")
    values = [inf, -inf, *map(float, range(1000)), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v, int(v) if abs(v) < 1e9 else None) for v in values], "x double, k int")
    ordered = sorted(values)
    ranks = [0.0, 1 / 1007, 0.5, 1006 / 1007, 1.0]
    for most in (0, 100, 100_000):  # a range that is infinite, more distinct values than fit at once
        x, k = stats.selected_quantiles(df, ["x", "k"], ranks, most=most)
        assert x == pytest.approx([ordered[round(r * 1007)] if r != 0.5 else (ordered[503] + ordered[504]) / 2 for r in ranks])
        assert k == pytest.approx(np.quantile([int(v) for v in values if abs(v) < 1e9], ranks).tolist())
    assert np.isnan(stats.selected_quantiles(spark.createDataFrame([(inf,), (-inf,)], "x double"), "x", [0.5])[0])
    assert stats.selected_quantiles(spark.createDataFrame([(inf,), (inf,)], "x double"), "x", [0.5]) == [inf]
    p = stats.patterns(np.array(ordered))
    assert (p[1:] >= p[:-1]).all() and (stats.numbers(p) == ordered).all()
