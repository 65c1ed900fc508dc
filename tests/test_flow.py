"""Raw movie files to answers, with the expected rows written out."""

import datetime as dt

import landing
import pytest

from lakegraph.operators.triples import BASE
from lakegraph.plans import flow
from lakegraph.plans import movies as m


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    return flow.read_landing(spark, landing.write(tmp_path_factory.mktemp("landing")), partitions=2)


@pytest.fixture(scope="module")
def formatted(raw):
    return flow.format_all(raw)


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_titles(formatted):
    got = _rows(formatted["titles"], "tconst")
    assert len(got) == 6
    assert got["tt0000001"]["primaryTitle"] == '"Unclosed quote' and got["tt0000001"]["genres"] == ["Documentary", "Short"]
    second = got["tt0000002"]
    assert second["primaryTitle"] == "Elan" and second["isAdult"] is True and second["startYear"] is None
    assert second["endYear"] is None and not second["genres"]
    assert got["tt0000005"]["primaryTitle"] == "E e"


def test_movies_users_ratings(formatted):
    movies = _rows(formatted["movies"], "movie_id")
    assert movies["tt0000008"]["movie_title"] == "Edison Kinetoscopic Record" and movies["tt0000008"]["movie_year"] == 1894
    assert movies["tt0000010"]["movie_title"] == "La sortie des usines" and movies["tt0000010"]["genres"] is None
    assert movies["tt0000099"]["movie_title"] == "Amelie" and movies["tt0000099"]["movie_year"] is None
    assert _rows(formatted["users"], "user_id")["2"]["twitter_id"] is None
    ratings = {r["movie_id"]: r for r in formatted["ratings"].collect()}
    assert ratings["tt0000008"]["rating_timestamp"] == dt.datetime(2013, 10, 5, 21, 0, 50)
    assert ratings["tt0000099"]["rating"] is None and ratings["tt0000099"]["rating_timestamp"] is None


def test_crew_detail(formatted):
    rows = formatted["crew_detail"].collect()
    assert sorted(r["known_for"] for r in rows) == ["77", "tt0000001", "tt0000002"]
    assert {(r["imdb_id"], r["gender"], r["original_name"]) for r in rows} == {("nm0000001", "Male", "Fred")}


def test_lookup_candidates(formatted):
    got = flow.lookup_candidates(formatted["ratings"], formatted["title_crew"])
    assert sorted(r[0] for r in got.collect()) == ["nm0000001", "nm0000002"]


def test_trusted(formatted):
    trusted = flow.constrain_all(formatted, as_of_year=2020)
    ids = lambda name, key: sorted(r[key] for r in trusted[name].collect())
    assert ids("titles", "tconst") == ["tt0000001", "tt0000005", "tt0000006"]
    assert "originalTitle" not in trusted["titles"].columns
    assert ids("title_crew", "tconst") == ["tt0000001", "tt0000002"]
    assert ids("people", "nconst") == ["nm0000001", "nm0000003", "nm0000004"]
    assert ids("movies", "movie_id") == ["tt0000008", "tt0000010", "tt0000099"]
    assert "movie_year" not in trusted["movies"].columns
    assert ids("users", "user_id") == ["1"]
    assert [r["rating_timestamp"] for r in trusted["ratings"].orderBy("movie_id").collect()] == [
        "2013-10-05 21:00:52", "2013-10-05 21:00:50"]
    assert ids("crew_detail", "known_for") == ["tt0000001", "tt0000002"]


def test_missing_lists_can_drop_their_row(formatted):
    assert [r[0] for r in m.constrain_title_crew(formatted["title_crew"], "drop").collect()] == ["tt0000001"]
    people = m.constrain_people(formatted["people"], 2020, "drop")
    assert sorted(r[0] for r in people.collect()) == ["nm0000001", "nm0000003"]
    with pytest.raises(ValueError):
        m.constrain_title_crew(formatted["title_crew"], "keep")


def test_all_stages(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    lake = flow.Lake(landing.write(folder), *[str(tmp_path / x) for x in ("formatted", "trusted", "graph", "analysis")])
    answers = flow.run_stages(spark, lake, as_of_year=2020)
    assert [tuple(r) for r in answers["profession_gender"].collect()] == [("actor", "Male", 1)]
    table = answers["profession_gender_table"].first()
    assert (table["Male"], table["Female"]) == (1, 0)
    evolution = sorted(tuple(r) for r in answers["genre_evolution"].collect())
    assert evolution == [(1900, "Sci Fi", 1), (1900, "Short", 1)]  # 1894 and 1900 are not after 1900
    assert answers["top_genre_table"].count() == 1
    graph = spark.read.parquet(lake.graph)
    triples = {(r["s"].removeprefix(BASE), r["p"].rsplit("/", 1)[-1], r["o"].removeprefix(BASE)) for r in graph.collect()}
    assert graph.count() == len(triples)
    assert ("Movie/tt0000005", "has_genre", "Genre/Sci%20Fi") in triples
    assert ("Participates/nm0000001_tt0000001", "participates_role", "Profession/director") in triples
    assert ("Participates/nm0000001_tt0000001", "participates_role", "Profession/writer") in triples
    assert ("Person/nm0000001", "primary_profession", "Profession/actor") in triples
    assert ("Person/nm0000001", "alternative_profession", "Profession/producer") in triples
    assert not any(s == "Person/nm0000003" and p == "isKnownfor" for s, p, _ in triples)
    assert ("Rating/1_tt0000008", "rating_date", "2013-10-05T21:00:50") in triples
    assert ("Known_for/nm0000001_tt0000002", "known_for_popularity", "1.5") in triples


def test_quality_report(formatted):
    report = flow.quality_report(formatted["movies"])
    assert report["redundancy"].first()[0] == pytest.approx(4 / 3)
    assert {r["column"]: r["missing_ratio"] for r in report["column_completeness"].collect()}["genres"] == 0.25
    assert report["relation_completeness"].first()[0] == 0.25
    assert report["profile"].filter("column = '*' AND metric = 'row_count'").first()["value"] == 4


def test_keys_beyond_32_bits(spark, tmp_path):
    """Customers of a large table keep their row, whatever their number."""
    from __spark_entry__ import queries
    big = [0, 4, 2 ** 31, 2 ** 31 + 1, 9_000_000_002]
    day = dt.datetime(1995, 3, 1)
    tables = {
        "customer": ([(k, f"C{k}", k % 2) for k in big], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(0, "PERU", 1), (1, "CHINA", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "orders": ([(k + 7, k, day, "1-URGENT") for k in big], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "part": ([(5, "x")], "p_partkey long, p_name string"),
        "supplier": ([(9_000_000_000, 0)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    genders = {1: "Female", 2: "Male", 3: "Non-binary"}
    want = {("genre", "1990", "1-URGENT", len(big))}
    people = [(("PERU", "CHINA")[k % 2], genders[1 + k % 3]) for k in big]
    want |= {("profession", *x, people.count(x)) for x in people}
    assert {tuple(r) for r in queries()["flow_answers"](spark, str(tmp_path)).collect()} == want
