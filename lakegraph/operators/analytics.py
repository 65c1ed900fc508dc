"""The two questions asked of the graph, and their report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import decade_of
from .bgp import bgp_match
from .relational import group_count, pivot_fill
from .triples import BASE, RDF_TYPE


def profession_gender_counts(graph, base: str = BASE, **options) -> DataFrame:
    """(professionName, gender, count) of people by primary profession."""
    solutions = bgp_match(graph, [
        ("?person", RDF_TYPE, base + "Person"),
        ("?person", base + "gender", "?gender"),
        ("?person", base + "primary_profession", "?profession"),
        ("?profession", base + "profession_name", "?professionName"),
    ], **options)
    return group_count(solutions, ["professionName", "gender"], "person")


def profession_gender_table(counts: DataFrame, genders: list[str] | None = None) -> DataFrame:
    return pivot_fill(counts, "professionName", "gender", "count", genders)


def genre_evolution(graph, base: str = BASE, after: int = 1900, **options) -> DataFrame:
    """(decade, genreName, count) of works with a start year later than ``after``."""
    solutions = bgp_match(graph, [
        ("?movie", base + "startYear", "?year"),
        ("?movie", RDF_TYPE, base + "Movie"),
        ("?movie", base + "has_genre", "?genre"),
        ("?genre", base + "genre_name", "?genreName"),
    ], **options)
    year = F.col("year").try_cast("int")
    dated = solutions.filter(year > after).withColumn("decade", decade_of(year))
    return group_count(dated, ["decade", "genreName"], "movie")


def top_genres(counts: DataFrame, k: int = 5) -> DataFrame:
    """The rows of the ``k`` genres with the largest totals; ties in name order.

    A genre carries its decades along (a list with one entry per decade), so the counts are
    computed once and not a second time to find out which genres lead.
    """
    by_genre = counts.groupBy("genreName").agg(
        F.sum("count").alias("total"), F.collect_list(F.struct("decade", "count")).alias("decades"))
    top = by_genre.orderBy(F.desc("total"), "genreName").limit(k)
    return top.select("genreName", F.inline("decades")).select("decade", "genreName", "count")


def genre_table(counts: DataFrame, genres: list[str] | None = None) -> DataFrame:
    return pivot_fill(counts, "decade", "genreName", "count", genres)
