"""Parsing and normalising raw fields, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim, unquote and upper-case all column names."""
    return df.toDF(*[c.strip().strip('"').strip().upper() for c in df.columns])


def find_column(df: DataFrame, aliases: Iterable[str]) -> str | None:
    """The first alias that is a column of ``df``, ignoring case."""
    present = {c.upper(): c for c in df.columns}
    return next((present[a.upper()] for a in aliases if a.upper() in present), None)


def resolve_columns(df: DataFrame, aliases: Mapping[str, Iterable[str]], required: bool = True) -> DataFrame:
    """Rename each logical column from the first of its aliases that is there."""
    for name, options in aliases.items():
        found = find_column(df, [name, *options])
        if found is None and required:
            raise ValueError(f"no column for {name!r} among {df.columns}")
        if found is not None and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def _text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(column.cast("string"), '"', ""))


def parse_date(column: Column | str) -> Column:
    """ISO dates and DDMMYYYY (a lost leading zero is put back); anything else is null."""
    s = _text(column)
    day_first = F.when(s.rlike("^[0-9]{7,8}$"), F.lpad(s, 8, "0"))
    return F.coalesce(F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(day_first, F.lit("ddMMyyyy"))))


def parse_day_first(column: Column | str, *backups: Column | str) -> Column:
    """dd/MM/yyyy, row by row from the first column that has a date."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(_text(c), F.lit("dd/MM/yyyy"))) for c in (column, *backups)])


def with_date_fallback(df: DataFrame, column: str, by: list[str], out: str = "date") -> DataFrame:
    """ISO dates, or for a group (a file) without a single ISO date the day-first layout."""
    s = _text(column)
    iso = F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    other = F.to_date(F.try_to_timestamp(F.lpad(s, 8, "0"), F.lit("ddMMyyyy")))
    parsed = df.withColumn("_iso", iso)
    seen = parsed.groupBy(*by).agg((F.count("_iso") > 0).alias("_any"))
    return parsed.join(seen, by).withColumn(out, F.when(F.col("_any"), F.col("_iso")).otherwise(other)).drop("_iso", "_any")


def backup_dates(df: DataFrame, primary: str, backups: list[str], limit: float = 0.5) -> Column:
    """The primary date column, filled from the backups only if more than ``limit`` of it is null."""
    share = df.agg((1 - F.count(primary) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("s")).first()["s"]
    return F.coalesce(primary, *backups) if share > limit else F.col(primary)


def number(column: Column | str) -> Column:
    """A lenient number: null where the text is none."""
    return F.expr(f"try_cast({column} as double)") if isinstance(column, str) else column.try_cast("double")


def decode_age(column: Column | str, variant: str = "A", unit: Column | str | None = None) -> Column:
    """Age in years from a coded age.

    A: 400 and more are years + 400, below that less than a year (0). B: below 200 plain years, 200-399 are
    0. C: as B, but 200-399 are unknown. D: a leading 4 of three or more digits is cut off, else plain
    digits. E: 400 and more are years + 400, else unknown. F: tvvv with t = 4 years, 3 months, 2 days, 1
    hours. G: a value with ``unit`` 3 years, 2 days, 1 hours.
    """
    s = _text(column)
    v = F.floor(s.try_cast("double")).cast("int")
    if variant == "A":
        return F.when(v >= 400, v - 400).when(v.isNotNull(), 0)
    if variant == "B":
        return F.when(v >= 400, v - 400).when(v < 200, v).when(v.isNotNull(), 0)
    if variant == "C":
        return F.when(v >= 400, v - 400).when(v < 200, v)
    if variant == "D":
        digits = F.when(s.startswith("4") & (F.length(s) >= 3), F.substring(s, 2, 10)).otherwise(s)
        return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    if variant == "E":
        return F.when(v >= 400, v - 400)
    if variant == "F":
        kind, value = F.floor(v / 1000), v % 1000
        return F.floor(F.when(kind == 4, value).when(kind == 3, value / 12).when(kind == 2, value / 365).when(kind == 1, 0)).cast("int")
    if variant == "G":
        u = F.col(unit) if isinstance(unit, str) else unit
        return F.floor(F.when(u == 3, v).when(u == 2, v / 365).when(u == 1, 0)).cast("int")
    raise ValueError(f"unknown variant {variant!r}")


def decode_sex(column: Column | str) -> Column:
    """M or F from words (masc..., fem...) or codes 1 and 2; else null."""
    s = F.lower(_text(column))
    return F.when(s.startswith("masc") | s.isin("1", "m"), "M").when(s.startswith("fem") | s.isin("2", "f"), "F")


def classify_cause(column: Column | str, strict: bool = False) -> Column:
    """cvd (I), respiratory (J), external (V, W, X, Y) or other, by a code's first letter.

    ``strict`` asks for two digits after the letter.
    """
    s = F.upper(_text(column))
    head = F.substring(s, 1, 1)
    ok = s.rlike("^[A-Z][0-9]{2}") if strict else F.lit(True)
    return F.when(ok & (head == "I"), "cvd").when(ok & (head == "J"), "respiratory").when(ok & head.isin("V", "W", "X", "Y"), "external").otherwise("other")


def cause_flags(column: Column | str) -> dict[str, Column]:
    """Overlapping 0/1 flags: respiratory, cardiovascular, direct heat."""
    s = F.coalesce(F.upper(_text(column)), F.lit(""))
    return {"is_resp": s.startswith("J").cast("int"), "is_cvd": s.startswith("I").cast("int"), "is_heat": (s.startswith("T67") | s.startswith("X30")).cast("int")}


def municipality_code(column: Column | str, seven_digits: bool = False) -> Column:
    """The six-digit code: the first six digits, or a seven-digit number without its check digit."""
    if seven_digits:
        c = F.col(column) if isinstance(column, str) else column
        return F.floor(c / 10).cast("int")
    return F.substring(_text(column), 1, 6).try_cast("int")


def case_flags(classification: str, outcome: str, age: str) -> dict[str, Column]:
    """Flags of a surveillance record: virus (1 influenza, 5 covid, 2 other), death (2, 3), elderly (60+)."""
    c, o = F.col(classification), F.col(outcome)
    return {k: F.coalesce(v, F.lit(False)) for k, v in {"is_influenza": c == 1, "is_covid": c == 5, "is_other_virus": c == 2, "is_death": o.isin(2, 3), "is_elderly": F.col(age) >= 60}.items()}


def lookup(column: Column | str, table: Mapping[str, str], default: str = "UNKNOWN") -> Column:
    """A value from a small table of the caller; ``default`` for the rest."""
    c = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast("string")), F.lit(default)) if pairs else F.lit(default)


def kelvin_to_celsius(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column) - 273.15


def temperature_in_celsius(df: DataFrame, column: str) -> Column:
    """The column in Celsius: taken for Kelvin if its mean is above 200 (one aggregate)."""
    mean = df.agg(F.avg(column)).first()[0]
    return kelvin_to_celsius(column) if mean is not None and mean > 200 else F.col(column)


def to_micrograms(column: Column | str) -> Column:
    """kg/m3 to ug/m3."""
    return (F.col(column) if isinstance(column, str) else column) * 1e9


def to_dobson(column: Column | str) -> Column:
    """kg/m2 of ozone to Dobson units."""
    return (F.col(column) if isinstance(column, str) else column) / 2.1415e-5


def calendar_features(date: Column | str, start: Column | str | None = None) -> dict[str, Column]:
    """year, month, day of year, weekday (Monday 1 .. Sunday 7) and, given a start, the time index in days."""
    d = F.col(date) if isinstance(date, str) else date
    out = {"year": F.year(d), "month": F.month(d), "doy": F.dayofyear(d), "dow": F.weekday(d) + 1}
    return out | ({"time": F.datediff(d, F.col(start) if isinstance(start, str) else start)} if start is not None else {})


def iso_week(date: Column | str) -> dict[str, Column]:
    """ISO year, ISO week and the week's Monday."""
    d = F.col(date) if isinstance(date, str) else date
    return {"iso_year": F.extract(F.lit("YEAROFWEEK"), d).cast("int"), "iso_week": F.weekofyear(d), "week_start": F.trunc(d, "week")}


def age_band(age: Column | str, edges: tuple[int, ...] = (60, 70, 80), last: str = "80+") -> Column:
    """Half-open bands [a, b) labelled ``a-b`` with inclusive ends, the last one open; below the first: null."""
    a = F.col(age) if isinstance(age, str) else age
    out = F.when(a >= edges[-1], last)
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        out = out.when((a >= low) & (a < high), f"{low}-{high - 1}")
    return out


def apparent_temperature(temperature: str, dewpoint: str) -> Column:
    """T + 0.33 e - 4 with the Magnus vapour pressure; humidity kept in 0-100; T where there is no dew point."""
    t, d = F.col(temperature), F.col(dewpoint)
    saturated = lambda x: 6.112 * F.exp(17.67 * x / (x + 243.5))
    humidity = F.least(F.greatest(100 * saturated(d) / saturated(t), F.lit(0.0)), F.lit(100.0))
    return F.coalesce(t + 0.33 * (humidity / 100 * saturated(t)) - 4.0, t)


def rate_per_100k(count: Column | str, population: Column | str) -> Column:
    c, p = (F.col(x) if isinstance(x, str) else x for x in (count, population))
    return F.when(p > 0, c / p * 100000)


def ratio_capped(part: Column | str, whole: Column | str, scale: float = 100.0, cap: float | None = 100.0) -> Column:
    """scale * part / whole, at most ``cap``; null where the whole is zero."""
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    out = p * scale / F.nullif(w, F.lit(0))
    return F.when(out > cap, cap).otherwise(out) if cap is not None else out


def growth(old: str, new: str) -> dict[str, Column]:
    """Absolute and relative growth (percent; null from zero)."""
    return {"growth_abs": F.col(new) - F.col(old), "growth_rel": (F.col(new) - F.col(old)) * 100 / F.nullif(F.col(old), F.lit(0))}


def level_category(column: Column | str, edges: tuple[float, float, float], labels: tuple[str, str, str, str]) -> Column:
    """Four levels by three lower edges: the first label below the first edge."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c >= edges[2], labels[3]).when(c >= edges[1], labels[2]).when(c >= edges[0], labels[1]).when(c.isNotNull(), labels[0])


def match_pattern(column: Column | str, patterns: list[tuple[str, str]], default: str) -> Column:
    """The label of the first substring that the lower-cased text contains."""
    s = F.lower(F.col(column) if isinstance(column, str) else column)
    out = F.lit(default)
    for part, label in reversed(patterns):
        out = F.when(s.contains(part), label).otherwise(out)
    return out


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (anonymous computus), by integer arithmetic."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + m - 7 * div(a + 11 * h + 22 * m, 451) + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def carnival_days(years: DataFrame, year_col: str = "year") -> DataFrame:
    """(year, date): Saturday to Tuesday before Ash Wednesday, 50 to 47 days before Easter."""
    found = years.select(year_col, easter(F.col(year_col)).alias("_e"))
    return found.select(year_col, F.explode(F.sequence(F.date_sub("_e", 50), F.date_sub("_e", 47))).alias("date"))


def harvesting_label(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c > 0.2, "strong displacement").when(c > 0.05, "some displacement").when(c >= -0.05, "none").when(c.isNotNull(), "delayed effects")


def attenuation_label(percent: Column | str) -> Column:
    c = F.abs(F.col(percent) if isinstance(percent, str) else percent)
    return F.when(c < 5, "robust").when(c < 10, "slight").when(c.isNotNull(), "substantial")


def stars(p: Column | str) -> Column:
    """Significance marks at 0.001, 0.01 and 0.05."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
