"""The stages in order: landing to formatted to trusted to graph to answers.

Each stage writes its tables and the next one reads them, so a lost executor or a failed run
repeats one stage and not the whole flow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import (genre_evolution, genre_table, profession_gender_counts, profession_gender_table,
                                   top_genres)
from ..operators.bgp import predicate_counts
from ..operators.profile import (column_completeness, descriptive_profile, profile_report, redundancy_ratio,
                                 relation_completeness)
from ..operators.relational import semi_join, union_distinct
from ..operators.triples import BASE, set_of_triples
from ..sources.readers import read_csv, read_delimited, read_json_map, read_table
from ..sources.sinks import write_table, write_triples
from . import movies as m


@dataclass(frozen=True)
class Lake:
    """Where the layers are."""

    landing: str
    formatted: str
    trusted: str
    graph: str
    analysis: str


def read_landing(spark: SparkSession, landing: str, partitions: int | None = None,
                 detail_lines: bool = False) -> dict[str, DataFrame]:
    """The raw files by data set. ``partitions`` spreads rows of files that cannot be split."""
    tsv = lambda name, schema: read_delimited(spark, f"{landing}/{name}", schema, "\t", True, partitions=partitions)
    dat = lambda name, schema: read_delimited(spark, f"{landing}/{name}", schema, "::")
    detail = spark.createDataFrame([], m.RAW_CREW_DETAIL).schema
    return {
        "titles": tsv("title.basics.tsv.gz", m.RAW_TITLES),
        "title_crew": tsv("title.crew.tsv.gz", m.RAW_TITLE_CREW),
        "people": tsv("name.basics.tsv.gz", m.RAW_PEOPLE),
        "movies": dat("movies.dat", m.RAW_MOVIES),
        "users": dat("users.dat", m.RAW_USERS),
        "ratings": dat("ratings.dat", m.RAW_RATINGS),
        "crew_detail": read_json_map(spark, f"{landing}/crew_data.json", detail, detail_lines),
        "links": read_csv(spark, f"{landing}/links.csv", m.RAW_LINKS),
    }


def lookup_candidates(ratings: DataFrame, title_crew: DataFrame) -> DataFrame:
    """Ids of the people who worked on a rated title: the ones worth looking up elsewhere.

    ``ratings`` and ``title_crew`` are formatted tables.
    """
    rated = semi_join(title_crew, ratings.select(F.col("movie_id").alias("tconst")), "tconst")
    return union_distinct("nconst", rated.select(F.explode("directors")), rated.select(F.explode("writers")))


def format_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "titles": m.format_titles(raw["titles"]),
        "title_crew": m.format_title_crew(raw["title_crew"]),
        "people": m.format_people(raw["people"]),
        "movies": m.format_movies(raw["movies"]),
        "users": m.format_users(raw["users"]),
        "ratings": m.format_ratings(raw["ratings"]),
        "crew_detail": m.format_crew_detail(raw["crew_detail"], raw["links"]),
    }


def constrain_all(formatted: dict[str, DataFrame], as_of_year: int | None = None,
                  null_arrays: str = "empty") -> dict[str, DataFrame]:
    return {
        "titles": m.constrain_titles(formatted["titles"], as_of_year),
        "title_crew": m.constrain_title_crew(formatted["title_crew"], null_arrays),
        "people": m.constrain_people(formatted["people"], as_of_year, null_arrays),
        "movies": m.constrain_movies(formatted["movies"]),
        "users": m.constrain_users(formatted["users"]),
        "ratings": m.constrain_ratings(formatted["ratings"]),
        "crew_detail": m.constrain_crew_detail(formatted["crew_detail"]),
    }


def quality_report(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """Profile, completeness by column and by row, redundancy: one frame each."""
    return {
        "profile": profile_report(descriptive_profile(df, approx)),
        "column_completeness": column_completeness(df),
        "relation_completeness": relation_completeness(df),
        "redundancy": redundancy_ratio(df),
    }


def build_graph(trusted: dict[str, DataFrame]) -> DataFrame:
    """All mapped tables as one set of triples with their inferred types."""
    return set_of_triples(*[(trusted[name], mapping()) for name, mapping in m.MAPPINGS.items()], ontology=m.ontology())


def answers(graph: DataFrame, keep=lambda name, df: df) -> dict[str, DataFrame]:
    """The two questions and their tables. ``graph`` is stored by predicate and has its inferred types.

    ``keep(name, frame)`` writes a frame and gives back what was written; counts are kept before the
    tables are made of them, so each question is asked once.
    """
    asked = [BASE + p for p in ("gender", "primary_profession", "profession_name", "startYear", "has_genre", "genre_name")]
    options = {"counts": predicate_counts(graph, asked), "entailed": m.ontology()}
    professions = keep("profession_gender", profession_gender_counts(graph, **options))
    genres = keep("genre_evolution", genre_evolution(graph, **options))
    top = keep("top_genres", top_genres(genres))
    named = [r[0] for r in top.select("genreName").distinct().orderBy("genreName").collect()]  # at most five
    return {
        "profession_gender": professions,
        "profession_gender_table": keep("profession_gender_table", profession_gender_table(professions, list(m.STATED_GENDERS))),
        "genre_evolution": genres,
        "top_genre_table": keep("top_genre_table", genre_table(top, named)),
    }


def run_stages(spark: SparkSession, lake: Lake, as_of_year: int | None = None,
               detail_lines: bool = False) -> dict[str, DataFrame]:
    """Every stage from landing to answers, each layer written before the next one starts.

    ``detail_lines``: the people lookups are one JSON document per line, which splits over tasks.
    """

    def store(tables: dict[str, DataFrame], layer: str) -> dict[str, DataFrame]:
        for name, df in tables.items():
            write_table(df, f"{layer}/{name}")
        return {name: read_table(spark, f"{layer}/{name}") for name in tables}

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # gzip files come as one task each
    formatted = store(format_all(read_landing(spark, lake.landing, spread, detail_lines)), lake.formatted)
    trusted = store(constrain_all(formatted, as_of_year), lake.trusted)
    write_triples(build_graph(trusted), lake.graph)
    return answers(read_table(spark, lake.graph), lambda name, df: store({name: df}, lake.analysis)[name])
