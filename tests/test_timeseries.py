"""Range-wise results against one plain window over the whole table."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegraph.operators import timeseries as ts
from lakegraph.operators.sliding import SortedBlocks, frame_elements


def _series(spark, seed, n=400, crowded=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = 100 if crowded and i % 3 == 0 else rng.randrange(n // 2)
        v = None if rng.random() < 0.4 or 120 < t < 160 else float(rng.randrange(5 if crowded else 1000))
        rows.append((rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=t), i, v))
    if crowded:
        rows += [("a", dt.datetime(2024, 1, 1, 1), 9999, 3.0)] * n
    return spark.createDataFrame(rows, "g string, ts timestamp, id int, v double")


def _plain_outliers(df, series, window=7):
    w = Window.partitionBy(*(series or [F.lit(0)])).orderBy("ts", "v")
    first = F.row_number().over(Window.partitionBy(*series, "ts").orderBy("v"))
    inc = df.withColumn("inc", F.coalesce(F.col("v") - F.lag("v", 1).over(w), F.lit(0.0))).withColumn("first", first)
    frame = w.rowsBetween(-(window - 1), 0)
    q = lambda p: F.expr(f"percentile_approx(inc, {p}, 1000000)").over(frame)
    out = inc.withColumns({"q1": q(0.25), "q3": q(0.75)}).filter("first = 1")
    return out.select(*series, "ts", F.col("inc").alias("increase_v"), (F.col("inc") > F.col("q3") + 7.5 * (F.col("q3") - F.col("q1"))).alias("is_outlier_v"))


@pytest.mark.parametrize("series", [[], ["g"]])
@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("rows", [15, 100_000])
def test_outliers_equal_one_window(spark, series, crowded, rows):
    df = _series(spark, 1, crowded=crowded)
    got = ts.rolling_iqr_outliers(df, "v", "ts", partition_cols=series, rows_per_bucket=rows)
    assert sorted(got.collect(), key=str) == sorted(_plain_outliers(df, series).collect(), key=str)


@pytest.mark.parametrize("series", [[], ["g"]])
@pytest.mark.parametrize("rows", [40, 100_000])
def test_long_frames_equal_one_window(spark, series, rows, monkeypatch):
    for window in (7, 90, 1000):
        monkeypatch.setattr(ts, "SHORT_FRAME", 6)
        df = _series(spark, 3, 300, crowded=window == 90)
        got = ts.rolling_iqr_outliers(df, "v", "ts", window, partition_cols=series, rows_per_bucket=rows)
        assert sorted(got.collect(), key=str) == sorted(_plain_outliers(df, series, window).collect(), key=str)


def test_elements_of_sliding_frames():
    rng = random.Random(2)
    values = [rng.choice([1.5, -2.0, float("nan"), float("inf"), 3.0, rng.random()]) for _ in range(400)]
    for size in (1, 3, 50, 1000):
        got = frame_elements(values, size, (0.25, 0.5, 1.0))
        for i in range(len(values)):
            frame = sorted(values[max(0, i - size + 1):i + 1], key=lambda x: (x != x, x))
            want = [frame[math.ceil(q * len(frame)) - 1] for q in (0.25, 0.5, 1.0)]
            assert str([g[i] for g in got]) == str(want)
    blocks, kept = SortedBlocks(4), []
    for i in range(3000):
        if kept and rng.random() < 0.45:
            blocks.remove(kept.pop(rng.randrange(len(kept))))
        else:
            kept.append(rng.randrange(60))
            blocks.add(kept[-1])
        if kept:
            k = rng.randrange(len(kept))
            assert blocks.at_rank(k + 1) == sorted(kept)[k]
    assert max(map(len, blocks.blocks)) <= 8


@pytest.mark.parametrize("series", [[], ["g"]])
@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("rows", [15, 100_000])
def test_lag_diff_equals_one_window(spark, series, crowded, rows):
    df = _series(spark, 2, crowded=crowded)
    got = ts.lag_diff(df, "v", "ts", series, rows_per_bucket=rows)
    w = Window.partitionBy(*(series or [F.lit(0)])).orderBy("ts", "v", F.xxhash64(*df.columns))
    want = df.withColumn("increase_v", F.coalesce(F.col("v") - F.lag("v", 1).over(w), F.lit(0.0)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("series", [[], ["g"]])
@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("rows", [15, 100_000])
@pytest.mark.parametrize("how", ["missing", "adjacent", "latest"])
def test_fill_equals_one_window(spark, series, crowded, rows, how):
    df = _series(spark, 3, crowded=crowded)
    w = Window.partitionBy(*(series or [F.lit(0)])).orderBy("ts", "id", F.xxhash64(*df.columns))
    prev = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if how == "latest":
        nxt = F.when(nxt.isNotNull(), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    plain = df.withColumns({"p": prev, "n": nxt})
    value = F.coalesce("v", (F.col("p") + F.col("n")) / 2, "p", "n")
    if how == "missing":
        got = ts.interpolate_missing(df, "ts", ["v"], series, ["id"], rows)
    else:
        value = F.coalesce(value, F.lit(0.0))
        got = ts.interpolate_impute(df, ["v"], "ts", how, series, ["id"], rows)
    want = plain.select("g", "ts", "id", value.alias("v"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def _numbers(spark, *values):
    rows = [(dt.date(2024, 1, i + 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "DATE date, x double")


def _x(df):
    return [r["x"] for r in df.orderBy("DATE").collect()]


def test_interpolation_cases(spark):
    assert _x(ts.interpolate_missing(_numbers(spark, None, 1.0, None, 5.0, None), "DATE")) == [1, 1, 3, 5, 5]
    assert _x(ts.interpolate_missing(_numbers(spark, None, None), "DATE", ["x"])) == [None, None]
    series = _numbers(spark, 1.0, None, 5.0, 100.0)
    assert _x(ts.interpolate_impute(series, ["x"], "DATE"))[1] == 3.0
    assert _x(ts.interpolate_impute(series, ["x"], "DATE", "latest"))[1] == 50.5
    assert _x(ts.interpolate_impute(_numbers(spark, None), ["x"], "DATE")) == [0.0]
    with pytest.raises(ValueError):
        ts.interpolate_impute(series, ["x"], "DATE", "nearest")


def test_outlier_cases(spark):
    constant = ts.rolling_iqr_outliers(_numbers(spark, *[2.0] * 9), "x", "DATE")
    assert not any(r["is_outlier_x"] for r in constant.collect())
    spike = ts.rolling_iqr_outliers(_numbers(spark, *[1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 500.0, 1.0]), "x", "DATE")
    assert [r["is_outlier_x"] for r in spike.orderBy("DATE").collect()] == [False] * 7 + [True, False]
    short = ts.rolling_iqr_outliers(_numbers(spark, 1.0, None), "x", "DATE")
    assert [r["increase_x"] for r in short.orderBy("DATE").collect()] == [0, 0]
    assert ts.rolling_iqr_outliers(_numbers(spark, 1.0).limit(0), "x", "DATE").count() == 0


def test_flags_are_added_to_every_row(spark):
    df = _numbers(spark, 1.0, 2.0)
    out = ts.attach_outlier_flags(df.union(df), ts.rolling_iqr_outliers(df, "x", "DATE"), "DATE")
    assert out.count() == 4 and out.columns == ["DATE", "x", "increase_x", "is_outlier_x"]


def test_outliers_of_several_columns(spark):
    df = _series(spark, 5).withColumn("u", (F.col("v") * 7 % 11).cast("int"))
    both = ts.outliers_of_columns(df, ["v", "u"], "ts", partition_cols=["g"], rows_per_bucket=40)
    for c in ("v", "u"):
        one = ts.rolling_iqr_outliers(df.withColumn(c, F.col(c).cast("double")), c, "ts", partition_cols=["g"], rows_per_bucket=40)
        assert sorted(map(str, both.select("g", "ts", f"is_outlier_{c}").collect())) == sorted(
            map(str, one.select("g", "ts", f"is_outlier_{c}").collect()))
    assert ts.attach_outlier_flags(df, both, "ts", ["g"]).filter("is_outlier_v IS NULL").count() == 0


def test_missing_dates(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "d string")
    gap = ts.check_missing_dates(days("2024-01-01", "2024-01-04", "2024-01-04"), "d")
    assert [str(r["date"]) for r in gap.missing.orderBy("date").collect()] == ["2024-01-02", "2024-01-03"]
    assert gap.all_dates.count() == 4 and not gap.is_complete()
    assert ts.check_missing_dates(days("2024-01-01"), "d").is_complete()
    assert ts.check_missing_dates(days(None), "d").is_complete()


def test_no_window_without_partitions(spark):
    df = _series(spark, 4)
    for out in (ts.lag_diff(df, "v", "ts", rows_per_bucket=50), ts.rolling_iqr_outliers(df, "v", "ts", rows_per_bucket=50)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "BatchEvalPython" not in plan
