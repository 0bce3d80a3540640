"""The streaming count against the batch count."""

import datetime as dt

from epispark.streaming.daily import daily_counts, run_available


def test_daily_counts_equal_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, region int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = run_available(daily_counts(stream, "ts", ["region"], "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {(r.date, r.region): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for t, g in rows:
        want[t.date(), g] = want.get((t.date(), g), 0) + 1
    closed = {k: v for k, v in want.items() if k[0] <= max(want)[0] - dt.timedelta(2)}
    assert closed and all(got[k] == v for k, v in closed.items()) and all(want[k] == v for k, v in got.items())
