import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakegraph.functions import text, values
from lakegraph.operators import relational as rel


def _one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("  a \t\n b  ", "a b"), ("", ""), (None, None)])
def test_whitespace(spark, raw, want):
    assert _one(spark, raw, text.collapse_whitespace(F.col("x"))) == want


@pytest.mark.parametrize("raw, want", [
    ("À la carte é", "A la carte e"), ("Straße œuvre Æsir", "Strasse oeuvre AEsir"), ("Łódź ø", "Lodz o"),
    ("é", "e"), ("“x” – y…", '"x" - y...'), ("ascii", "ascii"), ("", None), (None, None), ("日本", "日本"),
    ("Θεός Ἀθήνα Ψυχή", "Theos Athena Psukhe"), ("Юрий Щукин ёж Чехов", "Iurii Shchukin ezh Chekhov")])
def test_accents(spark, raw, want):
    assert _one(spark, raw, text.strip_accents(F.col("x"))) == want


def test_clean_strings_touches_text_columns_only(spark):
    df = spark.createDataFrame([(" N/A ", 1, [" x "]), ("\\N", 2, None)], "a string, n int, `l l` array<string>")
    assert [r["a"] for r in text.clean_strings(df).collect()] == [None, "\\N"]
    rows = text.clean_strings(df, text.NA_TOKENS_BACKSLASH).collect()
    assert [r["a"] for r in rows] == [None, None] and rows[0]["l l"] == [" x "]


def test_title_year(spark):
    df = spark.createDataFrame([("T (1999)",), ("T (99)",), ("(2001) T",), (None,)], "t string")
    got = [tuple(r) for r in text.split_title_year(df, "t", "y").collect()]
    assert got == [("T", 1999), ("T (99)", None), ("(2001) T", None), (None, None)]


def test_arrays(spark):
    assert _one(spark, "a|b||c", text.clean_array(text.split_to_array(F.col("x"), "|"))) == ["a", "b", "c"]
    assert _one(spark, None, text.split_to_array(F.col("x"), "|")) is None


def test_values(spark):
    assert _one(spark, "abc", values.safe_cast(F.col("x"), "int")) is None
    assert _one(spark, "86400", values.format_timestamp(values.epoch_to_timestamp(F.col("x")))) == "1970-01-02 00:00:00"
    assert _one(spark, "xyz", values.epoch_to_timestamp(F.col("x"))) is None
    assert _one(spark, 9, values.map_codes(F.col("x"), {0: "a"}), "x int") is None
    assert _one(spark, 0, values.map_codes(F.col("x"), {0: "a"}), "x int") == "a"
    assert _one(spark, 1999, values.decade_of(F.col("x")), "x int") == 1990


def test_explode(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "k int, l array<string>")
    assert values.explode_list(df, "l").count() == 1
    assert values.explode_list(df, "l", keep_empty=True).count() == 3


def test_project_nested(spark):
    df = spark.sql("SELECT array(named_struct('id', 1, 'popularity', 2.0D, 'overview', 'long'), NULL) AS l")
    assert df.select(values.project_nested(F.col("l"), "id", "popularity")).first()[0] == [(1, 2.0)]


def test_map_ids_fans_out_and_survives_bad_text(spark):
    df = spark.createDataFrame([(5,), (77,), (None,)], "id int")
    links = spark.createDataFrame([("5", "tt1"), ("5", "tt2"), ("x", "tt3"), (None, "tt4")], "t string, m string")
    got = rel.map_ids(df, links, "id", "t", "m", "known_for")
    assert sorted(((r["id"], r["known_for"]) for r in got.collect()), key=str) == [
        (5, "tt1"), (5, "tt2"), (77, "77"), (None, None)]


def test_union_distinct_drops_missing_ids(spark):
    a = spark.createDataFrame([("x",), ("",), ("\\N",), (None,)], "a string")
    assert [r[0] for r in rel.union_distinct("id", a, a).collect()] == ["x"]


def test_first_row_by_key(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(rel.drop_duplicates_by_key(df, ["k"], [F.asc("v")]).collect()) == [(1, "a"), (2, "c")]
    assert sorted(rel.pivot_fill(df.withColumn("n", F.lit(1)), "k", "v", "n").collect()) == [(1, 1, 1, 0), (2, 0, 0, 1)]


def test_pivot_of_too_many_names_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k long, v string, n long")
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(AnalysisException):
            rel.pivot_fill(df, "k", "v", "n")
        assert sorted(rel.pivot_fill(df, "k", "v", "n", ["a", "b", "c"]).collect()) == [(1, 1, 2, 0), (2, 0, 0, 3)]
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
