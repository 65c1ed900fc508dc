"""The movie data sets: schemas, formatting, constraints, mappings and ontology.

The operators know nothing about movies; this module is their configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators.constraints import Rule, apply_constraints, array_all, between, null_or, trim_percentiles
from ..operators.relational import map_ids
from ..operators.triples import BASE, ITEM, XSD, Attr, ForEach, Link, Mapping, Node, Type

# Column names and types of the raw files.
RAW_TITLES = ("tconst string, titleType string, primaryTitle string, originalTitle string, isAdult int, "
              "startYear int, endYear string, runtimeMinutes int, genres string")
RAW_TITLE_CREW = "tconst string, directors string, writers string"
RAW_PEOPLE = ("nconst string, primaryName string, birthYear string, deathYear string, "
              "primaryProfession string, knownForTitles string")
RAW_MOVIES = "movie_id string, movie_title string, genres string"
RAW_USERS = "user_id string, twitter_id string"
RAW_RATINGS = "user_id string, movie_id string, rating string, rating_timestamp string"
RAW_LINKS = "movieId int, imdbId string, tmdbId string"
RAW_CREW_DETAIL = (
    "imdb_id string, tmdb_data struct<id bigint, name string, original_name string, media_type string, adult boolean, "
    "popularity double, gender int, known_for_department string, profile_path string, "
    "known_for array<struct<id int, popularity double>>>")

# Gender codes.
GENDERS = {0: "NotSet", 1: "Female", 2: "Male", 3: "Non-binary"}
STATED_GENDERS = ("Female", "Male", "Non-binary")

TITLE_PREFIX, PERSON_PREFIX = "tt", "nm"
FIRST_YEAR = 1800


# ---- formatting: raw to typed ------------------------------------------------------------------

def _split(df: DataFrame, sep: str, tokens, *cols: str) -> DataFrame:
    clean = lambda c: text.clean_array(text.split_to_array(F.col(c), sep), tokens)
    return df.withColumns({c: clean(c) for c in cols})


def _ascii(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: text.strip_accents(F.col(c)) for c in cols})


def format_titles(raw: DataFrame) -> DataFrame:
    df = _ascii(text.clean_strings(raw, text.NA_TOKENS_BACKSLASH), "primaryTitle", "originalTitle")
    df = _split(df, ",", text.NA_TOKENS_BACKSLASH, "genres")
    return df.withColumn("isAdult", values.flag_to_boolean(F.col("isAdult")))


def format_title_crew(raw: DataFrame) -> DataFrame:
    df = text.clean_strings(raw, text.NA_TOKENS_BACKSLASH)
    return _split(df, ",", text.NA_TOKENS_BACKSLASH, "directors", "writers")


def format_people(raw: DataFrame) -> DataFrame:
    df = text.clean_strings(raw, text.NA_TOKENS_BACKSLASH)
    df = df.withColumns({c: values.safe_cast(F.col(c), "int") for c in ("birthYear", "deathYear")})
    return _split(df, ",", text.NA_TOKENS_BACKSLASH, "primaryProfession", "knownForTitles")


def format_movies(raw: DataFrame) -> DataFrame:
    df = text.clean_strings(raw)
    df = _ascii(text.split_title_year(df, "movie_title", "movie_year"), "movie_title")
    df = _split(df, "|", text.NA_TOKENS, "genres")
    df = df.withColumn("movie_id", text.prefix_id(F.col("movie_id"), TITLE_PREFIX))
    return df.select("movie_id", "movie_title", "movie_year", "genres")


def format_users(raw: DataFrame) -> DataFrame:
    return text.clean_strings(raw)


def format_ratings(raw: DataFrame) -> DataFrame:
    df = text.clean_strings(raw)
    return df.withColumns({
        "movie_id": text.prefix_id(F.col("movie_id"), TITLE_PREFIX),
        "rating": values.safe_cast(F.col("rating"), "int"),
        "rating_timestamp": values.epoch_to_timestamp(F.col("rating_timestamp")),
    })


def format_crew_detail(raw: DataFrame, links: DataFrame) -> DataFrame:
    """``raw`` is ``(key, value)`` with ``RAW_CREW_DETAIL`` records; ``links`` maps work ids."""
    flat = values.flatten_struct(raw, {
        "imdb_id": "value.imdb_id", "tmdb_id": "value.tmdb_data.id", "name": "value.tmdb_data.name",
        "original_name": "value.tmdb_data.original_name", "media_type": "value.tmdb_data.media_type",
        "adult": "value.tmdb_data.adult", "popularity": "value.tmdb_data.popularity",
        "gender": "value.tmdb_data.gender", "known_for_department": "value.tmdb_data.known_for_department",
        "profile_path": "value.tmdb_data.profile_path", "works": "value.tmdb_data.known_for",
    })
    works = values.explode_list(flat, "works", "work")
    works = works.withColumns({"work_id": F.col("work.id"), "known_for_popularity": F.col("work.popularity")})
    prefixed = links.withColumn("imdbId", text.prefix_id(F.col("imdbId"), TITLE_PREFIX))
    mapped = map_ids(works, prefixed, "work_id", "tmdbId", "imdbId", "known_for")
    df = text.clean_strings(mapped.select(
        "imdb_id", "tmdb_id", "name", "original_name", "media_type", "adult", "popularity",
        values.map_codes(F.col("gender"), GENDERS).alias("gender"),
        "known_for_department", "profile_path", "known_for", "known_for_popularity"))
    return _ascii(df, "name", "original_name")


# ---- constraints: typed to trusted -------------------------------------------------------------

def _starts(col: str, prefix: str) -> Rule:
    return Rule(f"{col} starts {prefix}", F.col(col).startswith(prefix))


def _not_null(*cols: str) -> list[Rule]:
    return [Rule(f"{c} not null", F.col(c).isNotNull()) for c in cols]


def _year(col: Column, this_year: Column) -> Column:
    return between(col, F.lit(FIRST_YEAR), this_year)


def _this_year(as_of_year: int | None) -> Column:
    return F.lit(as_of_year) if as_of_year else F.year(F.current_date())


def constrain_titles(df: DataFrame, as_of_year: int | None = None) -> DataFrame:
    now = _this_year(as_of_year)
    return apply_constraints(df, title_rules(now), ("originalTitle",))


def title_rules(now: Column) -> list[Rule]:
    end = values.safe_cast(F.col("endYear"), "int")
    return [
        Rule("runtime not negative", F.col("runtimeMinutes") >= 0),
        Rule("adult flag set", F.col("isAdult").isNotNull()),
        Rule("start year plausible", _year(F.col("startYear"), now)),
        Rule("end year absent or plausible", null_or(F.col("endYear"), _year(end, now))),
    ]


def constrain_title_crew(df: DataFrame, null_arrays: str = "empty") -> DataFrame:
    """``null_arrays``: a missing list counts as ``empty``, or makes its row ``drop``."""
    df = _clean_lists(df, null_arrays, "directors", "writers")
    people = lambda c: array_all(F.col(c), lambda x: x.startswith(PERSON_PREFIX))
    return apply_constraints(df, [
        *_not_null("tconst"), _starts("tconst", TITLE_PREFIX),
        Rule("directors are people", people("directors")),
        Rule("writers are people", people("writers")),
        Rule("somebody named", (F.size("directors") != 0) | (F.size("writers") != 0)),
    ])


def constrain_people(df: DataFrame, as_of_year: int | None = None, null_arrays: str = "empty") -> DataFrame:
    now = _this_year(as_of_year)
    df = _clean_lists(df, null_arrays, "knownForTitles")
    birth, death = F.col("birthYear"), F.col("deathYear")
    return apply_constraints(df, [
        *_not_null("nconst"), _starts("nconst", PERSON_PREFIX),
        Rule("birth year absent or plausible", null_or(birth, _year(birth, now))),
        Rule("death year absent or plausible", null_or(death, _year(death, now))),
        Rule("born before death", birth.isNull() | death.isNull() | (birth <= death)),
        Rule("known for titles", array_all(F.col("knownForTitles"), lambda x: x.startswith(TITLE_PREFIX))),
    ])


def constrain_movies(df: DataFrame) -> DataFrame:
    rules = [*_not_null("movie_id"), _starts("movie_id", TITLE_PREFIX)]
    return apply_constraints(df, rules, ("movie_year",)).dropDuplicates()


def constrain_users(df: DataFrame) -> DataFrame:
    return apply_constraints(df, _not_null("user_id", "twitter_id")).dropDuplicates()


def constrain_ratings(df: DataFrame) -> DataFrame:
    rules = [*_not_null("user_id", "movie_id"), Rule("rating 0 to 10", between(F.col("rating"), 0, 10))]
    kept = apply_constraints(df, rules)
    return kept.withColumn("rating_timestamp", values.format_timestamp(F.col("rating_timestamp"))).dropDuplicates()


def constrain_crew_detail(df: DataFrame, popularity_null_ratio: float | None = None,
                          rel_error: float = 0.01) -> DataFrame:
    """Without ``popularity_null_ratio`` the share of missing values is measured on ``df`` first."""
    rules = [
        *_not_null("imdb_id", "tmdb_id"), _starts("imdb_id", PERSON_PREFIX),
        Rule("popularity not negative", F.col("popularity") >= 0),
        Rule("work popularity not negative", F.col("known_for_popularity") >= 0),
        Rule("gender stated", F.col("gender").isin(*STATED_GENDERS)),
        Rule("adult flag set", F.col("adult").isNotNull()),
        _starts("known_for", TITLE_PREFIX),
    ]
    if popularity_null_ratio is None:
        popularity_null_ratio = df.agg(F.avg(F.col("popularity").isNull().cast("double"))).first()[0] or 0.0
    kept = apply_constraints(df, rules, ("original_name",))
    trimmed = trim_percentiles(kept, "popularity", null_ratio_before=popularity_null_ratio, rel_error=rel_error)
    return trimmed.dropDuplicates()


def _clean_lists(df: DataFrame, null_arrays: str, *cols: str) -> DataFrame:
    if null_arrays not in ("empty", "drop"):
        raise ValueError(f"null_arrays is {null_arrays!r}; it must be one of: drop, empty")
    df = df.withColumns({c: text.clean_array(F.col(c)) for c in cols})
    if null_arrays == "drop":
        return df.filter(" AND ".join(f"{c} IS NOT NULL" for c in cols))
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in cols})


# ---- graph: trusted to triples -----------------------------------------------------------------

_GENRES = ForEach("genres", (
    Type(Node("Genre", ITEM)),
    Attr(Node("Genre", ITEM), "genre_name", ITEM),
))


def _genres(movie: Node) -> ForEach:
    return ForEach("genres", (*_GENRES.steps, Link(movie, "has_genre", Node("Genre", ITEM))))


def titles_mapping() -> Mapping:
    movie = Node("Movie", "tconst")
    return Mapping((
        Type(movie),
        Attr(movie, "title", "primaryTitle"),
        Attr(movie, "movieId", "tconst"),
        Attr(movie, "startYear", "startYear", "integer"),
        Attr(movie, "runtime", "runtimeMinutes", "integer"),
        _genres(movie),
    ), F.col("tconst").startswith(TITLE_PREFIX))


def title_crew_mapping() -> Mapping:
    movie, person, part = Node("Movie", "tconst"), Node("Person", ITEM), Node("Participates", ITEM, "tconst")

    def role(array: str, name: str) -> ForEach:
        profession = Node("Profession", F.lit(name))
        return ForEach(array, (
            Type(person), Type(part), Type(profession),
            Link(part, "participates_role", profession),
            Link(part, "participates_person", person),
            Link(part, "participates_movie", movie),
        ))

    return Mapping((Type(movie), role("directors", "director"), role("writers", "writer")),
                   F.col("tconst").startswith(TITLE_PREFIX))


def people_mapping() -> Mapping:
    person, profession = Node("Person", "nconst"), Node("Profession", ITEM)
    movie, known = Node("Movie", ITEM), Node("Known_for", "nconst", ITEM)
    return Mapping((
        Type(person),
        Attr(person, "personId", "nconst"),
        Attr(person, "name", "primaryName"),
        Attr(person, "birthYear", "birthYear", "integer"),
        Attr(person, "deathYear", "deathYear", "integer"),
        ForEach("primaryProfession", (
            Type(profession),
            Attr(profession, "profession_name", ITEM),
            Link(person, "primary_profession", profession, "first"),
            Link(person, "alternative_profession", profession, "rest"),
        )),
        # Works are linked only for people who have a profession.
        ForEach("knownForTitles", (
            Type(movie), Type(known),
            Link(person, "isKnownfor", known),
            Link(known, "known_for_movie", movie),
        ), F.size("primaryProfession") > 0),
    ), F.col("nconst").startswith(PERSON_PREFIX))


def crew_detail_mapping() -> Mapping:
    person, movie = Node("Person", "imdb_id"), Node("Movie", "known_for")
    known, work = Node("Known_for", "imdb_id", "known_for"), F.col("known_for").startswith(TITLE_PREFIX)
    return Mapping((
        Type(person),
        Attr(person, "personId", "imdb_id"),
        Attr(person, "name", "name"),
        Attr(person, "gender", "gender"),
        Attr(person, "popularity", "popularity", "float"),
        Type(movie, work),
        # The flag is the person's; it is what the source offers for the work.
        Attr(movie, "isAdult", "adult", "boolean", work),
        Type(known, work),
        Link(person, "isKnownfor", known, when=work),
        Link(known, "known_for_movie", movie, when=work),
        Attr(known, "known_for_popularity", "known_for_popularity", "float", work),
    ), F.col("imdb_id").startswith(PERSON_PREFIX))


def movies_mapping() -> Mapping:
    movie = Node("Movie", "movie_id")
    return Mapping((
        Type(movie),
        Attr(movie, "title", "movie_title"),
        Attr(movie, "movieId", "movie_id"),
        _genres(movie),
    ), F.col("movie_id").startswith(TITLE_PREFIX))


def ratings_mapping() -> Mapping:
    user, movie, rating = Node("User", "user_id"), Node("Movie", "movie_id"), Node("Rating", "user_id", "movie_id")
    title = F.col("movie_id").startswith(TITLE_PREFIX)
    rated = title & F.col("rating").isNotNull()
    moment = F.replace(F.col("rating_timestamp").cast("string"), F.lit(" "), F.lit("T"))
    return Mapping((
        Type(user),
        Attr(user, "userId", "user_id"),
        Type(movie, title),
        Type(rating, rated),
        Attr(rating, "rating_date", moment, "dateTime", rated),
        Attr(rating, "rating_score", "rating", "integer", rated),
        Link(rating, "rating_movie", movie, when=rated),
        Link(user, "rates_movie", rating, when=rated),
    ))


MAPPINGS = {
    "titles": titles_mapping, "title_crew": title_crew_mapping, "people": people_mapping,
    "movies": movies_mapping, "ratings": ratings_mapping, "crew_detail": crew_detail_mapping,
}

# Property, domain, range of the graph model; a lower-case range is a literal type.
_PROPERTIES = """
movieId Movie string
title Movie string
isAdult Movie boolean
startYear Movie integer
runtime Movie integer
userId User string
personId Person string
gender Person string
name Person string
popularity Person float
deathYear Person integer
birthYear Person integer
genre_name Genre string
rating_date Rating dateTime
rating_score Rating integer
known_for_popularity Known_for float
profession_name Profession string
participates_person Participates Person
participates_role Participates Profession
participates_movie Participates Movie
primary_profession Person Profession
alternative_profession Person Profession
isKnownfor Person Known_for
known_for_movie Known_for Movie
has_genre Movie Genre
rating_movie Rating Movie
rates_movie User Rating
"""
CLASSES = ("Movie", "Person", "User", "Rating", "Genre", "Profession", "Known_for", "Participates")


def ontology(base: str = BASE) -> list[dict]:
    out = []
    for line in _PROPERTIES.split("\n"):
        if line:
            prop, domain, range_ = line.split(" ")
            literal = range_ not in CLASSES
            out.append({"property": base + prop, "domain": base + domain,
                        "range": (XSD if literal else base) + range_, "range_is_literal": literal})
    return out
