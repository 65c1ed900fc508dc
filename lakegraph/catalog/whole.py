"""The whole flow as one query: raw text made of the tables, through every stage, to both answers."""

from functools import reduce

from pyspark.sql import functions as F

from ..plans import flow
from ..plans import movies as m
from ..session import work_path
from . import query


def landing(t) -> str:
    """Orders as titles with their priority as genre, customers as people with their nation as profession."""
    path = work_path(t.spark, "landing")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    title, person = text("tt", F.col("o_orderkey")), text("nm", F.col("c_custkey"))
    none = F.lit("\\N")
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def tsv(name, df, header):
        named = df.toDF(*header.split())
        named.write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(f"{path}/{name}.tsv.gz")

    def lines(name, df, *parts):
        df.select(reduce(lambda a, b: F.concat(a, F.lit("::"), b), [text(p) for p in parts]).alias("value")).write.text(f"{path}/{name}.dat")

    tsv("title.basics", t.orders.select(title, F.lit("movie"), title, title, F.lit(0), F.year("o_orderdate"), none, F.lit(90), "o_orderpriority"),
        "tconst titleType primaryTitle originalTitle isAdult startYear endYear runtimeMinutes genres")
    tsv("title.crew", t.orders.select(title, text("nm", F.col("o_custkey")), none), "tconst directors writers")
    tsv("name.basics", people.select(person, "c_name", F.lit(1950), none, "n_name", none),
        "nconst primaryName birthYear deathYear primaryProfession knownForTitles")
    lines("movies", t.part, text("p", F.col("p_partkey")), F.lit("A part (1999)"), F.lit("Part"))
    lines("users", t.supplier, F.col("s_suppkey"), F.col("s_nationkey"))
    lines("ratings", t.supplier, F.col("s_suppkey"), text("p", F.col("s_suppkey")), F.lit(5), F.lit(1381006850))
    t.spark.range(1).select(F.lit(1).alias("movieId"), F.lit("0000001").alias("imdbId"), F.lit("5").alias("tmdbId")).write.option(
        "header", True).csv(f"{path}/links.csv")
    work = F.array(F.struct(F.lit(5).alias("id"), F.lit(1.5).alias("popularity")))
    detail = F.struct(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"), F.col("c_name").alias("original_name"),
                      F.lit(False).alias("adult"), F.lit(2.5).alias("popularity"),
                      (1 + F.col("c_custkey") % 3).cast("int").alias("gender"), work.alias("known_for"))
    document = F.create_map(person, F.struct(person.alias("imdb_id"), detail.alias("tmdb_data")))
    t.customer.select(F.to_json(document).alias("value")).write.text(f"{path}/crew_data.json")
    return path


_GENDER = "CASE c_custkey % 3 " + " ".join(f"WHEN {code - 1} THEN '{name}'" for code, name in m.GENDERS.items() if code) + " END"


@query(f"""SELECT 'genre' AS question, (year(o_orderdate) // 10 * 10)::VARCHAR AS of, o_orderpriority AS name, count(*) AS count
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'profession', n_name, {_GENDER}, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def flow_answers(t):
    root = work_path(t.spark, "lake")
    lake = flow.Lake(landing(t), *[f"{root}/{layer}" for layer in ("formatted", "trusted", "graph", "analysis")])
    found = flow.run_stages(t.spark, lake, 2024, detail_lines=True)
    return found["genre_evolution"].select(F.lit("genre").alias("question"), F.col("decade").cast("string").alias("of"),
                                           F.col("genreName").alias("name"), "count").union(
        found["profession_gender"].select(F.lit("profession"), "professionName", "gender", "count"))


_COLUMNS = ("o_orderkey", "o_orderstatus", "priority")
_DISTINCT = " UNION ALL ".join(f"SELECT '{c}', 'distinct', (count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER))::DOUBLE FROM f" for c in _COLUMNS)


@query(f"""WITH f AS (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders
  UNION ALL SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') FROM orders WHERE o_orderstatus = 'P'),
r(name, metric, value) AS (SELECT '*', 'row_count', count(*)::DOUBLE FROM f UNION ALL SELECT '*', 'column_count', 3 UNION ALL {_DISTINCT}
  UNION ALL SELECT 'o_orderkey', unnest(['count', 'mean', 'stddev', 'min', 'max']),
    unnest([count(o_orderkey), avg(o_orderkey), stddev_samp(o_orderkey), min(o_orderkey), max(o_orderkey)]::DOUBLE[]) FROM f),
c(name, value) AS (SELECT unnest(['o_orderkey', 'o_orderstatus', 'priority']), unnest([avg((o_orderkey IS NULL)::INTEGER), avg((o_orderstatus IS NULL)::INTEGER), avg((priority IS NULL)::INTEGER)]) FROM f)
SELECT 'profile' AS part, name, metric, round(value, 6) AS value FROM r
UNION ALL SELECT 'column_completeness', name, 'missing_ratio', round(value, 6) FROM c
UNION ALL SELECT 'relation_completeness', '*', 'complete_ratio', round(avg((o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL AND priority IS NOT NULL)::INTEGER), 6) FROM f
UNION ALL SELECT 'redundancy', '*', 'redundancy', round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT * FROM f)), 6) FROM f""")
def quality_report(t):
    """The report of a data set as one table: orders without some priorities, pending ones twice."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))
    report = flow.quality_report(rows.unionByName(rows.filter("o_orderstatus = 'P'")))
    row = lambda part, name, metric, value: (F.lit(part).alias("part"), name.alias("name"), metric.alias("metric"), F.round(value.cast("double"), 6).alias("value"))
    whole = F.lit("*")
    return (report["profile"].select(*row("profile", F.col("column"), F.col("metric"), F.col("value")))
            .union(report["column_completeness"].select(*row("column_completeness", F.col("column"), F.lit("missing_ratio"), F.col("missing_ratio"))))
            .union(report["relation_completeness"].select(*row("relation_completeness", whole, F.lit("complete_ratio"), F.col("complete_ratio"))))
            .union(report["redundancy"].select(*row("redundancy", whole, F.lit("redundancy"), F.col("redundancy")))))
