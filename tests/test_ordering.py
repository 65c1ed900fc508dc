import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegraph.operators import ordering as o


@pytest.fixture(scope="module")
def frame(spark):
    """A third of the rows share one key; some keys are null."""
    n = 5000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 997)
    return spark.range(n).select("id", key.cast("bigint").alias("k"), (F.col("id") * 7919 % n).alias("v"))


def test_one_range_for_a_small_table(spark):
    for n in (0, 10):
        ranges = o.cut_ranges(o.stored(spark.range(n).toDF("k"), "t"), ["k"])
        assert ranges.count() == n and ranges.select(o.BUCKET).distinct().count() <= 1


def test_ranges_follow_the_key_order(spark, frame):
    cut = o.cut_ranges(o.stored(frame, "t"), ["k", "v"], 100)
    spans = cut.groupBy(o.BUCKET).agg(F.min(F.struct("k", "v")).alias("lo"), F.max(F.struct("k", "v")).alias("hi"),
                                      F.count("*").alias("n")).orderBy(o.BUCKET).collect()
    key = lambda r: (r["k"] is not None, r["k"], r["v"])
    assert len(spans) > 20
    assert all(key(a["hi"]) < key(b["lo"]) for a, b in zip(spans, spans[1:]))
    assert max(r["n"] for r in spans) < 400  # the hot key is spread


def test_ranges_grow_with_the_root_of_the_table(spark, frame):
    assert o.cut_ranges(o.stored(frame, "t"), ["id"], 1).select(o.BUCKET).distinct().count() <= 72


@pytest.mark.parametrize("at_once", [3, 1000])
def test_copies_are_counted_and_made_again(spark, monkeypatch, at_once):
    monkeypatch.setattr(o, "COPIES_AT_ONCE", at_once)
    rows = [(1, None, {"a": 1, "b": 2})] * 7 + [(1, None, {"b": 2, "a": 1}), (2, "x", None), (2, "x", None), (3, None, {})]
    df = spark.createDataFrame(rows, "k int, s string, m map<string,int>")
    few = o.collapse_copies(df)
    assert sorted(r["_copies"] for r in few.collect()) == [1, 2, 8]
    again = o.expand_copies(few, 8).collect()
    assert sorted((r["k"], r["_i"]) for r in again) == [(1, i) for i in range(1, 9)] + [(2, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("rows", [100, 10_000])
def test_global_row_number(frame, rows):
    got = o.global_row_number(frame, ["k", "id"], "rn", rows)
    want = frame.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k", "id")))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_row_numbers_of_a_table_on_disk(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for keys in (["id"], ["v"], ["k", "id"]):
        got = o.global_row_number(stored, keys, "rn", 300)
        assert got.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (5000, 1, 5000)
        assert got.orderBy(*keys).select("rn").first()[0] == 1
        assert o.global_row_number(stored.withColumn("n", F.lit(2)), keys, "rn", 300, "n").agg(F.max("rn")).first()[0] == 10000


@pytest.mark.parametrize("rows", [5, 10_000])
def test_exact_quantiles(spark, rows):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=700).round(2), np.full(400, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probabilities = [0.0, 0.05, 0.5, 0.77, 0.95, 1.0]
    ordered = np.sort(values)
    want = [float(ordered[max(0, int(np.ceil(p * len(ordered) - 1e-9)) - 1)]) for p in probabilities]
    assert o.exact_quantiles(df, "v", probabilities, rows) == want


def test_quantiles_of_nothing(spark):
    assert o.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == []
