"""Constraints, trimming, profiles, metrics, imputation."""

from pyspark.sql import functions as F

from ..operators import constraints as con
from ..operators import impute, profile, states
from ..plans import movies as m
from ..session import work_path
from . import query


def titles(t):
    """Orders as titles. Pending orders have no flag, unspecified priority means no runtime."""
    year = F.year("o_orderdate")
    return t.orders.select(
        F.concat(F.lit("tt"), "o_orderkey").alias("tconst"),
        F.col("o_orderpriority").alias("titleType"),
        F.concat(F.lit("Order "), "o_orderkey").alias("primaryTitle"),
        F.concat(F.lit("Order "), "o_orderkey").alias("originalTitle"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("isAdult"),
        year.alias("startYear"),
        F.when(F.col("o_orderstatus") == "F", (year + 3).cast("string")).alias("endYear"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
               (F.floor(F.col("o_totalprice") / 1000) - 10).cast("int")).alias("runtimeMinutes"),
        F.array("o_orderpriority", "o_orderstatus", F.lit("")).alias("genres"),
    )


TITLES_SQL = """SELECT 'tt' || o_orderkey::VARCHAR AS tconst, o_orderpriority AS titleType,
  'Order ' || o_orderkey::VARCHAR AS primaryTitle,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS isAdult, year(o_orderdate)::INTEGER AS startYear,
  CASE WHEN o_orderstatus = 'F' THEN (year(o_orderdate) + 3)::VARCHAR END AS endYear,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN (floor(o_totalprice / 1000) - 10)::INTEGER END AS runtimeMinutes,
  [o_orderpriority, o_orderstatus] AS genres FROM orders"""

_TITLE_RULES = """runtimeMinutes >= 0 AND isAdult IS NOT NULL AND startYear BETWEEN 1800 AND 2000
  AND (endYear IS NULL OR TRY_CAST(endYear AS INTEGER) BETWEEN 1800 AND 2000)"""


@query(f"""SELECT tconst, titleType, primaryTitle, isAdult, startYear, endYear, runtimeMinutes
FROM ({TITLES_SQL}) WHERE {_TITLE_RULES}""")
def constraints_titles(t):
    return m.constrain_titles(titles(t), as_of_year=2000).drop("genres")


@query(f"""WITH t AS ({TITLES_SQL}), f AS (SELECT coalesce(runtimeMinutes >= 0, false) AS a, isAdult IS NOT NULL AS b,
  startYear BETWEEN 1800 AND 2000 AS c,
  coalesce(endYear IS NULL OR TRY_CAST(endYear AS INTEGER) BETWEEN 1800 AND 2000, false) AS d FROM t)
SELECT 'runtime not negative' AS rule, count(*) FILTER (NOT a) AS rejected FROM f
UNION ALL SELECT 'adult flag set', count(*) FILTER (NOT b) FROM f
UNION ALL SELECT 'start year plausible', count(*) FILTER (NOT c) FROM f
UNION ALL SELECT 'end year absent or plausible', count(*) FILTER (NOT d) FROM f""")
def rejected_rows(t):
    return con.rejected_counts(titles(t), m.title_rules(F.lit(2000)))


def title_crew(t):
    """Line items as credits. Some have no directors, some an empty list, some a wrong prefix."""
    nm = lambda c: F.concat(F.lit("nm"), c)
    return t.lineitem.select(
        F.concat(F.lit("tt"), "l_orderkey").alias("tconst"),
        F.when(F.col("l_returnflag") != "N", F.array(nm("l_suppkey"), F.lit(""), F.lit(None))).alias("directors"),
        F.when(F.col("l_linestatus") == "O", F.array().cast("array<string>"))
        .when(F.col("l_tax") == 0, F.array(F.concat(F.lit("xx"), "l_partkey")))
        .otherwise(F.array(nm("l_partkey"))).alias("writers"),
    )


TITLE_CREW_SQL = """SELECT 'tt' || l_orderkey::VARCHAR AS tconst,
  CASE WHEN l_returnflag <> 'N' THEN 'nm' || l_suppkey::VARCHAR END AS director,
  CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_tax = 0 THEN 'xx' || l_partkey::VARCHAR
    ELSE 'nm' || l_partkey::VARCHAR END AS writer, l_returnflag = 'N' AS no_list FROM lineitem"""

_CREW_RULES = "(writer IS NULL OR writer LIKE 'nm%') AND NOT (director IS NULL AND writer IS NULL)"


def _joined(df, *cols):
    return df.select(*[F.array_join(c, ",").alias(c) if c in cols else c for c in df.columns])


@query(f"""SELECT tconst, coalesce(director, '') AS directors, coalesce(writer, '') AS writers
FROM ({TITLE_CREW_SQL}) WHERE {_CREW_RULES}""")
def constraints_crew(t):
    return _joined(m.constrain_title_crew(title_crew(t)), "directors", "writers")


@query(f"""SELECT tconst, coalesce(director, '') AS directors, coalesce(writer, '') AS writers
FROM ({TITLE_CREW_SQL}) WHERE {_CREW_RULES} AND NOT no_list""")
def constraints_crew_drop_missing(t):
    return _joined(m.constrain_title_crew(title_crew(t), null_arrays="drop"), "directors", "writers")


def people(t):
    """Customers as people. One segment has a wrong prefix, one has no titles, one no professions."""
    segment = F.col("c_mktsegment")
    return t.customer.select(
        F.concat(F.when(segment == "MACHINERY", "xx").otherwise("nm"), "c_custkey").alias("nconst"),
        F.col("c_name").alias("primaryName"),
        (F.col("c_nationkey") * 5 + 1780).cast("int").alias("birthYear"),
        F.when(F.col("c_acctbal") >= 0, (F.floor(F.col("c_acctbal") / 100) + 1850).cast("int")).alias("deathYear"),
        F.when(segment != "HOUSEHOLD", F.array(segment, F.concat(F.lit("role of "), "c_nationkey"))).alias("primaryProfession"),
        F.when(segment != "BUILDING", F.array(F.concat(F.lit("tt"), "c_custkey"), F.lit(""))).alias("knownForTitles"),
    )


PEOPLE_SQL = """SELECT (CASE WHEN c_mktsegment = 'MACHINERY' THEN 'xx' ELSE 'nm' END) || c_custkey::VARCHAR AS nconst,
  c_name AS primaryName, (c_nationkey * 5 + 1780)::INTEGER AS birthYear,
  CASE WHEN c_acctbal >= 0 THEN (floor(c_acctbal / 100) + 1850)::INTEGER END AS deathYear,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS first_profession,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'role of ' || c_nationkey::VARCHAR END AS second_profession,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN 'tt' || c_custkey::VARCHAR END AS known_title FROM customer"""


@query(f"""SELECT nconst, primaryName, birthYear, deathYear, coalesce(known_title, '') AS knownForTitles
FROM ({PEOPLE_SQL}) WHERE nconst LIKE 'nm%' AND birthYear BETWEEN 1800 AND 1940
  AND (deathYear IS NULL OR (deathYear BETWEEN 1800 AND 1940 AND birthYear <= deathYear))""")
def constraints_people(t):
    kept = m.constrain_people(people(t), as_of_year=1940)
    return _joined(kept.drop("primaryProfession"), "knownForTitles")


@query("""SELECT DISTINCT (CASE WHEN p_type = 'ECONOMY' THEN 'xx' ELSE 'tt' END) || p_size::VARCHAR AS movie_id,
  p_name AS movie_title FROM part WHERE p_type <> 'ECONOMY'""")
def constraints_movies(t):
    prefix = F.when(F.col("p_type") == "ECONOMY", "xx").otherwise("tt")
    movies = t.part.select(F.concat(prefix, "p_size").alias("movie_id"), F.col("p_name").alias("movie_title"),
                           F.col("p_size").alias("movie_year"))
    return m.constrain_movies(movies)


@query("""SELECT DISTINCT user_id::VARCHAR AS user_id, event_type AS twitter_id FROM events WHERE event_type <> 'error'""")
def constraints_users(t):
    users = t.events.select(F.col("user_id").cast("string").alias("user_id"),
                            F.when(F.col("event_type") != "error", F.col("event_type")).alias("twitter_id"))
    return m.constrain_users(users)


def ratings(t):
    """Line items as ratings; quantities above ten are out of range, returned items have none."""
    return t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.concat(F.lit("tt"), "l_partkey").alias("movie_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int")).alias("rating"),
        F.col("l_shipdate").cast("timestamp").alias("rating_timestamp"))


@query("""SELECT DISTINCT l_suppkey::VARCHAR AS user_id, 'tt' || l_partkey::VARCHAR AS movie_id,
  l_quantity::INTEGER AS rating, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS rating_timestamp
FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity BETWEEN 0 AND 10""")
def constraints_ratings(t):
    return m.constrain_ratings(ratings(t))


def crew_detail(t):
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.concat(F.lit("nm"), "l_suppkey").alias("imdb_id"), F.col("l_suppkey").alias("tmdb_id"),
        F.concat(F.lit("Supplier "), "l_suppkey").alias("name"), F.lit("x").alias("original_name"),
        (F.col("l_linestatus") == "F").alias("adult"), F.col("l_extendedprice").alias("popularity"),
        F.when(flag == "A", "Female").when(flag == "R", "Male").otherwise("NotSet").alias("gender"),
        F.concat(F.when(F.col("l_tax") == 0, "").otherwise("tt"), "l_partkey").alias("known_for"),
        (F.col("l_discount") - 0.02).alias("known_for_popularity"))


CREW_DETAIL_SQL = """SELECT 'nm' || l_suppkey::VARCHAR AS imdb_id, l_suppkey AS tmdb_id,
  'Supplier ' || l_suppkey::VARCHAR AS name, l_linestatus = 'F' AS adult, l_extendedprice AS popularity,
  CASE l_returnflag WHEN 'A' THEN 'Female' WHEN 'R' THEN 'Male' ELSE 'NotSet' END AS gender,
  (CASE WHEN l_tax = 0 THEN '' ELSE 'tt' END) || l_partkey::VARCHAR AS known_for,
  l_discount - 0.02 AS known_for_popularity FROM lineitem"""


@query(f"""WITH k AS (SELECT * FROM ({CREW_DETAIL_SQL}) WHERE popularity >= 0 AND known_for_popularity >= 0
  AND gender IN ('Female', 'Male', 'Non-binary') AND known_for LIKE 'tt%')
SELECT DISTINCT imdb_id, tmdb_id, name, adult, popularity, gender, known_for,
  round(known_for_popularity, 6) AS known_for_popularity FROM k
WHERE popularity BETWEEN (SELECT quantile_disc(popularity, 0.05) FROM k)
  AND (SELECT quantile_disc(popularity, 0.95) FROM k)""")
def constraints_crew_detail(t):
    kept = m.constrain_crew_detail(crew_detail(t), popularity_null_ratio=0.0, rel_error=0)
    return kept.withColumn("known_for_popularity", F.round("known_for_popularity", 6))


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN
  (SELECT quantile_disc(c_acctbal, 0.05) FROM customer) AND (SELECT quantile_disc(c_acctbal, 0.95) FROM customer)""")
def percentile_trim(t):
    return con.trim_percentiles(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", rel_error=0)


@query("SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p, true AS within_error")
def approx_quantile(t):
    """The sketch's values have the ranks asked for, give or take one percent."""
    asked, prices = [0.05, 0.5, 0.95], t.lineitem.select(F.col("l_extendedprice").alias("x"))
    found = prices.agg(F.percentile_approx("x", asked, 100).alias("q")).scalar()
    at = [F.element_at(found, i + 1) for i in range(3)]
    below = [F.avg((F.col("x") < q).cast("double")) for q in at]
    upto = [F.avg((F.col("x") <= q).cast("double")) for q in at]
    rows = [F.struct(F.lit(p).alias("p"), ((lo <= p + 0.01) & (hi >= p - 0.01)).alias("within_error"))
            for p, lo, hi in zip(asked, below, upto)]
    return prices.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders
WHERE year(o_orderdate) > 1998 AND o_orderpriority LIKE '%HIGH%'""")
def range_and_contains(t):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    return rows.filter((F.col("year") > 1998) & F.col("o_orderpriority").contains("HIGH")).drop("o_orderpriority")


def gappy_orders(t):
    """Orders whose unspecified priority and pending price count as missing."""
    return t.orders.select(
        "o_orderkey", F.col("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))


GAPPY_SQL = """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders"""


def _profile_sql():
    parts = ["SELECT '*' AS \"column\", 'row_count' AS metric, count(*)::DOUBLE AS value FROM g",
             "SELECT '*', 'column_count', 4::DOUBLE"]
    stats = {"count": "count", "mean": "avg", "stddev": "stddev_samp", "min": "min", "max": "max"}
    for c in ("o_orderkey", "price"):
        parts += [f"SELECT '{c}', '{s}', round({f}({c})::DOUBLE, 4) FROM g" for s, f in stats.items()]
    for c in ("o_orderkey", "o_orderstatus", "priority", "price"):
        parts.append(f"SELECT '{c}', 'distinct', (count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER))::DOUBLE FROM g")
    return f"WITH g AS ({GAPPY_SQL}) " + " UNION ALL ".join(parts)


@query(_profile_sql())
def profile_long(t):
    report = profile.profile_report(profile.descriptive_profile(gappy_orders(t)))
    return report.withColumn("value", F.round("value", 4))


@query(f"""WITH g AS ({GAPPY_SQL}) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INTEGER), 6) AS missing_ratio FROM g"
    for c in ("o_orderkey", "o_orderstatus", "priority", "price")))
def completeness(t):
    return profile.column_completeness(gappy_orders(t)).withColumn("missing_ratio", F.round("missing_ratio", 6))


@query(f"""SELECT round(avg((priority IS NOT NULL AND price IS NOT NULL)::INTEGER), 6) AS complete_ratio
FROM ({GAPPY_SQL})""")
def row_completeness(t):
    return profile.relation_completeness(gappy_orders(t)).select(F.round("complete_ratio", 6).alias("complete_ratio"))


@query("""SELECT round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM
  (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), 6) AS redundancy""")
def redundancy(t):
    ratio = profile.redundancy_ratio(t.lineitem.select("l_orderkey", "l_linenumber"))
    return ratio.select(F.round("redundancy", 6).alias("redundancy"))


@query("""SELECT 'o_totalprice' AS attribute, round(avg(1.0::DOUBLE / (1.0::DOUBLE +
  (date_diff('day', o_orderdate::DATE, DATE '2024-02-01') + 1e-9::DOUBLE) * 12.0::DOUBLE)), 9) AS timeliness_score
FROM orders""")
def timeliness(t):
    score = profile.attribute_timeliness(t.orders, "o_totalprice", "o_orderdate", as_of=F.to_date(F.lit("2024-02-01")))
    return score.withColumn("timeliness_score", F.round("timeliness_score", 9))


@query("""SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value LIMIT 1""")
def mode(t):
    return impute.mode(t.part, "p_brand")


@query("""SELECT value, n AS count FROM (SELECT l_quantity AS value, count(*) AS n,
  dense_rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY l_quantity) WHERE r = 1""")
def rank_values(t):
    return impute.rank_values(t.lineitem, "l_quantity")


@query(f"""WITH g AS ({GAPPY_SQL}) SELECT o_orderkey, o_orderstatus, priority,
  round(coalesce(price, (SELECT quantile_disc(price, 0.5) FROM g)), 4) AS price FROM g""")
def impute_median(t):
    filled = impute.impute_numerical(gappy_orders(t), ["price"], rel_error=0)
    return filled.withColumn("price", F.round("price", 4))


@query(f"""WITH g AS ({GAPPY_SQL}) SELECT o_orderkey, o_orderstatus, priority,
  round(coalesce(price, (SELECT avg(price) FROM g)), 4) AS price FROM g""")
def impute_mean(t):
    filled = impute.impute_numerical(gappy_orders(t), ["price"], strategy="mean")
    return filled.withColumn("price", F.round("price", 4))


@query(f"""WITH g AS (SELECT *, CASE WHEN o_orderstatus = 'Z' THEN 'x' END AS empty FROM ({GAPPY_SQL})),
  c AS (SELECT priority, count(*) AS n FROM g GROUP BY priority)
SELECT o_orderkey, o_orderstatus, coalesce(priority, (SELECT CASE
    WHEN coalesce((SELECT n FROM c WHERE priority IS NULL), 0) > (SELECT max(n) FROM c WHERE priority IS NOT NULL)
    THEN 'unknown' ELSE (SELECT priority FROM c WHERE priority IS NOT NULL ORDER BY n DESC, priority LIMIT 1) END)) AS priority,
  'unknown' AS empty FROM g""")
def impute_mode(t):
    """The nulls may be the most frequent value, and one column has nothing but nulls."""
    df = gappy_orders(t).withColumn("empty", F.when(F.col("o_orderstatus") == "Z", "x"))
    return impute.impute_with_mode(df).drop("price")


_SUMS = " UNION ALL ".join(
    f"SELECT '{c}' AS column, unnest(['row_count', 'missing_ratio', 'count', 'mean', 'stddev', 'min', 'max']) AS metric, "
    f"unnest([count(*), 1 - count({c}) / count(*), count({c}), avg({c}), stddev_samp({c}), min({c}), max({c})]::DOUBLE[]) AS value FROM f"
    for c in ("o_totalprice", "o_custkey"))


@query(f"""WITH f AS (SELECT o_orderstatus, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders),
r AS ({_SUMS} UNION ALL SELECT 'o_orderstatus', unnest(['row_count', 'missing_ratio']), unnest([count(*), 0]::DOUBLE[]) FROM f)
SELECT "column", metric, round(value, 4) AS value, true AS close FROM r
UNION ALL SELECT c, m, NULL, true FROM (VALUES ('o_totalprice'), ('o_custkey')) a(c), (VALUES ('distinct'), ('q25'), ('q50'), ('q75')) b(m)
UNION ALL SELECT 'o_orderstatus', 'distinct', NULL, true""")
def profile_of_loads(t):
    """Orders in a load per year, each profiled once; the report comes from the stored states alone.

    Estimates show only whether they are within their stated error of what all rows say.
    """
    rows = t.orders.select(F.year("o_orderdate").alias("load"), "o_orderstatus", "o_custkey",
                           F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"))
    path = work_path(t.spark, "states")
    states.profile_states(rows, ("load",)).write.partitionBy("load").parquet(path)
    report = states.states_report(states.merge_states(t.spark.read.parquet(path)))
    return _with_closeness(report, rows.drop("load"))


def _standing(x, v):
    """Partial sums that tell where ``v`` stands among all ``x``: how many there are, below it and up to it, and the next ones."""
    return F.struct(F.count(x).alias("n"), F.count_if(x < v).alias("below"), F.count_if(x <= v).alias("upto"),
                    F.max(F.when(x < v, x)).alias("before"), F.min(F.when(x >= v, x)).alias("at"),
                    F.max(F.when(x <= v, x)).alias("last"), F.min(F.when(x > v, x)).alias("after"))


def _between_percentiles(v, stands, low, high):
    """Whether ``v`` lies between the (interpolated) percentiles ``low`` and ``high``, without finding them."""
    def place(p):
        at = F.lit(p) * (stands["n"] - 1)
        return at, F.floor(at), F.ceil(at)

    def mixed(p, a, b):
        at, down, up = place(p)
        return a * (up - at) + b * (at - down)
    _, down, up = place(high)
    under = F.when(stands["below"] <= down, True).when(stands["below"] > up, False).otherwise(v <= mixed(high, stands["before"], stands["at"]))
    _, down, up = place(low)
    over = F.when(stands["upto"] > up, True).when(stands["upto"] <= down, False).otherwise(v >= mixed(low, stands["last"], stands["after"]))
    return F.when(v.isNotNull(), under & over)


def _with_closeness(report, rows):
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    numbers = [c for c in rows.columns if c != "o_orderstatus"]
    # Where a reported quantile stands among all values follows from counts and from its two neighbours.
    asked = report.agg(*[F.max(F.when((F.col("column") == c) & (F.col("metric") == m), F.col("value"))).alias(f"{c}_{m}") for c in numbers for m in shares])
    stands = lambda c, m: _standing(F.col(c).cast("double"), F.col(f"{c}_{m}")).alias(f"{c}_{m}")
    ends = rows.crossJoin(F.broadcast(asked)).agg(*[stands(c, m) for c in numbers for m in shares])
    truth = rows.agg(*[F.struct(F.count_distinct(c).alias("n"), F.max(F.col(c).isNull()).cast("long").alias("gap")).alias(c) for c in rows.columns])
    truth = truth.crossJoin(F.broadcast(ends))
    close = F.lit(True)
    for c in rows.columns:
        n = F.col(f"{c}.n") + F.col(f"{c}.gap")
        close = F.when((F.col("column") == c) & (F.col("metric") == "distinct"), F.abs(F.col("value") - n) <= states.DISTINCT_ERROR * n + 0.5).otherwise(close)
        for m, p in shares.items() if c in numbers else ():
            within = _between_percentiles(F.col("value"), F.col(f"{c}_{m}"), p - states.RANK_ERROR, p + states.RANK_ERROR)
            close = F.when((F.col("column") == c) & (F.col("metric") == m), within).otherwise(close)
    exact = ~F.col("metric").isin("distinct", *shares)
    one = F.lit(1).alias("_one")  # the statistics of all rows are one row
    return report.select("*", one).join(F.broadcast(truth.select("*", one)), "_one").select("column", "metric", F.when(exact, F.round("value", 4)).alias("value"), close.alias("close"))
