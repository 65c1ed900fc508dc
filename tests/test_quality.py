import pytest
from pyspark.sql import functions as F

from lakegraph.operators import constraints as con
from lakegraph.operators import impute, profile
from lakegraph.plans import movies as m


def _metrics(df):
    return {(r["column"], r["metric"]): r["value"] for r in df.collect()}


def test_profile(spark):
    df = spark.createDataFrame([(1, "x"), (3, None), (3, "x")], "n int, `a b` string")
    got = _metrics(profile.descriptive_profile(df))
    assert got["*", "row_count"] == 3 and got["*", "column_count"] == 2
    assert got["n", "mean"] == pytest.approx(7 / 3) and got["n", "stddev"] == pytest.approx(1.1547, abs=1e-4)
    assert got["n", "distinct"] == 2 and got["a b", "distinct"] == 2
    approx = _metrics(profile.descriptive_profile(df, approx=True))
    assert approx["n", "distinct"] == 2
    order = [r["metric"] for r in profile.profile_report(profile.descriptive_profile(df)).filter("column = 'n'").collect()]
    assert order == ["count", "mean", "stddev", "min", "max", "distinct"]


def test_profile_without_numbers_or_rows(spark):
    df = spark.createDataFrame([], "a string")
    got = _metrics(profile.descriptive_profile(df))
    assert got["*", "row_count"] == 0 and got["a", "distinct"] == 0 and ("a", "mean") not in got


def test_completeness(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`a b` int, c string")
    assert {r["column"]: r["missing_ratio"] for r in profile.column_completeness(df).collect()} == {"a b": 0.0, "c": 0.5}
    assert profile.relation_completeness(df).first()[0] == 0.5
    empty = df.limit(0)
    assert profile.column_completeness(empty).count() == 0
    assert profile.relation_completeness(empty).first()[0] == 0.0
    assert profile.redundancy_ratio(empty).first()[0] is None
    assert profile.redundancy_ratio(df.union(df)).first()[0] == 2.0


def test_timeliness(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2023-12-31'), (3, NULL) AS t(x, ts)")
    row = profile.attribute_timeliness(df, "x", "ts", 12, F.to_date(F.lit("2024-01-01"))).first()
    assert row["attribute"] == "x" and row["timeliness_score"] == pytest.approx((1 + 1 / 13) / 2, abs=1e-6)


def test_impute_numerical(spark):
    df = spark.createDataFrame([(1, 1.0, None, "a"), (None, 3.0, None, "b"), (3, 8.0, None, "c"), (9, None, None, "d")],
                               "i int, d double, e double, s string")
    rows = impute.impute_numerical(df, rel_error=0).orderBy("s").collect()
    assert rows[1]["i"] == 3.0 and rows[3]["d"] == 3.0 and rows[0]["e"] == 0.0
    sketch = impute.impute_numerical(df).orderBy("s").collect()
    assert sketch[1]["i"] == 3.0 and sketch[3]["d"] == 3.0
    mean = impute.impute_numerical(df, ["i"], "mean", -1.0).orderBy("s").collect()
    assert mean[1]["i"] == pytest.approx(13 / 3) and mean[3]["d"] is None
    assert impute.impute_numerical(df, ["e"], default_fill=7.0).first()["e"] == 7.0
    with pytest.raises(ValueError):
        impute.impute_numerical(df, strategy="mode")


def test_impute_with_mode(spark):
    df = spark.createDataFrame([("a", "y", None, None), ("a", "x", None, None), ("b", None, "z", None), (None, None, None, None)],
                               "clear string, tie string, nulls string, nothing string")
    rows = impute.impute_with_mode(df).collect()
    assert [r["clear"] for r in rows] == ["a", "a", "b", "a"]
    assert [r["nulls"] for r in rows] == ["unknown", "unknown", "z", "unknown"]
    assert {r["nothing"] for r in rows} == {"unknown"}
    assert [r["tie"] for r in rows] == ["y", "x", "unknown", "unknown"]
    assert impute.impute_with_mode(df.limit(0)).count() == 0
    assert impute.mode(df, "clear").first()["value"] == "a"
    assert {r["value"] for r in impute.rank_values(df.filter("tie IS NOT NULL"), "tie").collect()} == {"x", "y"}


def test_rules_drop_null_conditions_and_count(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rules = [con.Rule("positive", F.col("x") > 0), con.Rule("present", F.col("x").isNotNull())]
    assert [r["x"] for r in con.apply_constraints(df, rules, ("not there",)).collect()] == [1]
    assert {r["rule"]: r["rejected"] for r in con.rejected_counts(df, rules).collect()} == {"positive": 2, "present": 1}


def test_trim_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    kept = con.trim_percentiles(df, "x", rel_error=0)
    assert kept.agg(F.min("x"), F.max("x")).first() == (5.0, 95.0)
    assert con.trim_percentiles(df, "x", null_ratio_before=0.2).count() == 100
    assert con.trim_percentiles(df.limit(0), "x").count() == 0
    assert con.trim_percentiles(df.limit(0), "x", rel_error=0).count() == 0


def test_constraints_push_down_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("tt1", "A", 3)], "movie_id string, movie_title string, movie_year int").write.parquet(str(tmp_path / "m"))
    plan = m.constrain_movies(spark.read.parquet(str(tmp_path / "m")))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(movie_id,tt)" in plan and "movie_year" not in plan.split("ReadSchema")[1]
