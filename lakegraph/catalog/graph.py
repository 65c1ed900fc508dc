"""Rows to triples, entailment, patterns, and the questions asked of the graph."""

from pyspark.sql import functions as F

from ..operators import analytics
from ..operators.bgp import bgp_match as match
from ..operators.bgp import predicate_counts
from ..operators import entail_plus as plus
from ..operators.closure import transitive_closure
from ..operators.triples import (BASE, RDF_TYPE, XSD, Attr, Link, Mapping, Node, Source, Type, VirtualGraph,
                                 ForEach, set_of_triples, to_ntriples, union_triples)
from ..operators.triples import rejected_triples as rejected
from ..plans import movies as m
from ..session import work_path
from ..sources.readers import ontology_frame as ontology_rows
from ..sources.readers import read_table
from ..sources.sinks import write_graph_by_subject, write_triples
from . import query
from .quality import CREW_DETAIL_SQL, PEOPLE_SQL, TITLE_CREW_SQL, TITLES_SQL, crew_detail, people, ratings, title_crew, titles


def _iri(cls, key):
    return f"'{BASE}{cls}/' || replace({key}, ' ', '%20')"


def _type(node, cls, frm):
    return f"SELECT {node} AS s, '{RDF_TYPE}' AS p, '{BASE}{cls}' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_datatype FROM {frm}"


def _attr(node, prop, value, frm, datatype="string"):
    return f"SELECT {node}, '{BASE}{prop}', {value}::VARCHAR, 'literal', '{XSD}{datatype}' FROM {frm}"


def _link(node, prop, target, frm):
    return f"SELECT {node}, '{BASE}{prop}', {target}, 'iri', NULL FROM {frm}"


def _set(with_, *parts):
    return f"WITH {with_} SELECT * FROM (" + " UNION ".join(parts) + ") WHERE s IS NOT NULL AND o IS NOT NULL"


def _graph_set(df, mapping):
    return set_of_triples((df, mapping))


# A bucket of titles is sorted and joined by one task.
SUBJECTS_PER_BUCKET = 250_000

_M, _G = _iri("Movie", "tconst"), _iri("Genre", "genre")
TITLE_PARTS = (
    _type(_M, "Movie", "t"), _attr(_M, "title", "primaryTitle", "t"), _attr(_M, "movieId", "tconst", "t"),
    _attr(_M, "startYear", "startYear", "t", "integer"), _attr(_M, "runtime", "runtimeMinutes", "t", "integer"),
    _type(_G, "Genre", "g"), _attr(_G, "genre_name", "genre", "g"), _link(_M, "has_genre", _G, "g"),
)
_TITLES = f"t AS ({TITLES_SQL}), g AS (SELECT tconst, unnest(genres) AS genre FROM t)"


@query(_set(_TITLES, *TITLE_PARTS))
def titles_to_triples(t):
    return _graph_set(titles(t), m.titles_mapping())


def _crew_parts(col, role):
    person, part = _iri("Person", col), _iri("Participates", f"{col} || '_' || tconst")
    frm, profession = f"(SELECT * FROM k WHERE {col} IS NOT NULL)", f"'{BASE}Profession/{role}'"
    return (_type(person, "Person", frm), _type(part, "Participates", frm), _type(profession, "Profession", frm),
            _link(part, "participates_role", profession, frm), _link(part, "participates_person", person, frm),
            _link(part, "participates_movie", _M, frm))


@query(_set(f"k AS ({TITLE_CREW_SQL})", _type(_M, "Movie", "k"),
            *_crew_parts("director", "director"), *_crew_parts("writer", "writer")))
def crew_to_triples(t):
    return _graph_set(title_crew(t), m.title_crew_mapping())


_P, _K = _iri("Person", "nconst"), _iri("Known_for", "nconst || '_' || known_title")
_KM = _iri("Movie", "known_title")
_PROF = lambda c: _iri("Profession", c)
PEOPLE_PARTS = (
    _type(_P, "Person", "p"), _attr(_P, "personId", "nconst", "p"), _attr(_P, "name", "primaryName", "p"),
    _attr(_P, "birthYear", "birthYear", "p", "integer"), _attr(_P, "deathYear", "deathYear", "p", "integer"),
    *[x for c in ("first_profession", "second_profession") for x in (
        _type(_PROF(c), "Profession", "p"), _attr(_PROF(c), "profession_name", c, "p"))],
    _link(_P, "primary_profession", _PROF("first_profession"), "p"),
    _link(_P, "alternative_profession", _PROF("second_profession"), "p"),
    _type(_KM, "Movie", "w"), _type(_K, "Known_for", "w"), _link(_P, "isKnownfor", _K, "w"),
    _link(_K, "known_for_movie", _KM, "w"),
)
_PEOPLE = (f"p AS (SELECT * FROM ({PEOPLE_SQL}) WHERE nconst LIKE 'nm%'), "
           "w AS (SELECT * FROM p WHERE first_profession IS NOT NULL AND known_title IS NOT NULL)")


@query(_set(_PEOPLE, *PEOPLE_PARTS))
def people_to_triples(t):
    return _graph_set(people(t), m.people_mapping())


_D, _DM = _iri("Person", "imdb_id"), _iri("Movie", "known_for")
_DK = _iri("Known_for", "imdb_id || '_' || known_for")


@query(_set(f"d AS ({CREW_DETAIL_SQL}), w AS (SELECT * FROM d WHERE known_for LIKE 'tt%')",
            _type(_D, "Person", "d"), _attr(_D, "personId", "imdb_id", "d"), _attr(_D, "name", "name", "d"),
            _attr(_D, "gender", "gender", "d"), _type(_DM, "Movie", "w"),
            _attr(_DM, "isAdult", "adult", "w", "boolean"), _type(_DK, "Known_for", "w"),
            _link(_D, "isKnownfor", _DK, "w"), _link(_DK, "known_for_movie", _DM, "w"),
            _attr(_DK, "known_for_popularity", "round(known_for_popularity * 100)::INTEGER", "w", "float"),
            _attr(_D, "popularity", "round(popularity)::BIGINT", "d", "float")))
def crew_detail_to_triples(t):
    """Popularities are made whole, because engines write fractions differently."""
    df = crew_detail(t).withColumns({
        "popularity": F.round("popularity").cast("bigint"),
        "known_for_popularity": F.round(F.col("known_for_popularity") * 100).cast("int")})
    return _graph_set(df, m.crew_detail_mapping())


_MV = _iri("Movie", "movie_id")


@query(_set("mv AS (SELECT 'tt' || p_partkey::VARCHAR AS movie_id, p_name AS title, string_split(p_name, ' ') AS genres "
            "FROM part), g AS (SELECT movie_id, unnest(genres) AS genre FROM mv)",
            _type(_MV, "Movie", "mv"), _attr(_MV, "title", "title", "mv"), _attr(_MV, "movieId", "movie_id", "mv"),
            _type(_G, "Genre", "g"), _attr(_G, "genre_name", "genre", "g"), _link(_MV, "has_genre", _G, "g")))
def movies_to_triples(t):
    movies = t.part.select(F.concat(F.lit("tt"), "p_partkey").alias("movie_id"), F.col("p_name").alias("movie_title"),
                           F.split("p_name", " ").alias("genres"))
    return _graph_set(movies, m.movies_mapping())


_U, _R = _iri("User", "user_id"), _iri("Rating", "user_id || '_' || movie_id")
RATINGS_SQL = """SELECT l_suppkey::VARCHAR AS user_id, 'tt' || l_partkey::VARCHAR AS movie_id,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity::INTEGER END AS rating,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS moment FROM lineitem"""


@query(_set(f"r AS ({RATINGS_SQL}), k AS (SELECT * FROM r WHERE rating IS NOT NULL)",
            _type(_U, "User", "r"), _attr(_U, "userId", "user_id", "r"), _type(_MV, "Movie", "r"),
            _type(_R, "Rating", "k"), _attr(_R, "rating_date", "moment", "k", "dateTime"),
            _attr(_R, "rating_score", "rating", "k", "integer"), _link(_R, "rating_movie", _MV, "k"),
            _link(_U, "rates_movie", _R, "k")))
def ratings_to_triples(t):
    df = ratings(t).withColumn("rating_timestamp", F.date_format("rating_timestamp", "yyyy-MM-dd HH:mm:ss"))
    return _graph_set(df, m.ratings_mapping())


@query(_set(f"{_TITLES}, {_PEOPLE}", *TITLE_PARTS, *PEOPLE_PARTS))
def merge_graphs(t):
    """Titles and people meet in the works people are known for."""
    return set_of_triples((titles(t), m.titles_mapping()), (people(t), m.people_mapping()))


@query("""SELECT CASE WHEN o_kind = 'iri' THEN '<' || s || '> <' || p || '> <' || o || '> .'
  ELSE '<' || s || '> <' || p || '> "' || o || '"^^<' || o_datatype || '> .' END AS line FROM (""" + _set(_TITLES, *TITLE_PARTS) + ")")
def ntriples(t):
    return to_ntriples(_graph_set(titles(t), m.titles_mapping()))


def _entail_sql():
    ontology = m.ontology()
    values = ", ".join(f"('{r['property']}', '{r['domain']}', " + ("NULL" if r["range_is_literal"] else f"'{r['range']}'") + ")"
                       for r in ontology)
    base = _set(f"{_TITLES}, {_PEOPLE}", *TITLE_PARTS, *PEOPLE_PARTS)
    typed = f"'{RDF_TYPE}' AS p"
    return f"""WITH base AS ({base}), onto(prop, dom, ran) AS (VALUES {values})
SELECT * FROM base
UNION SELECT s, {typed}, dom, 'iri', NULL FROM base JOIN onto ON base.p = onto.prop
UNION SELECT o, {typed}, ran, 'iri', NULL FROM base JOIN onto ON base.p = onto.prop WHERE ran IS NOT NULL AND o_kind = 'iri'"""


@query(_entail_sql())
def entail_types(t):
    """Only links and attributes are given; the types follow from them."""
    return set_of_triples((titles(t), m.titles_mapping()), (people(t), m.people_mapping()), ontology=m.ontology())


@query(f"""SELECT '{RDF_TYPE}' AS p, 0 AS rejected UNION ALL
SELECT '{BASE}title', count(*) FILTER (o_orderstatus = 'P') FROM orders UNION ALL
SELECT '{BASE}has_country', count(*) FILTER (o_orderstatus = 'P' AND year(o_orderdate) > 1995) FROM orders UNION ALL
SELECT '{BASE}has_genre', coalesce(sum(len(string_split(o_orderpriority, '-'))) FILTER (o_orderstatus = 'P'), 0) FROM orders""")
def rejected_triples(t):
    """Pending orders have no name; every triple that needs one is counted."""
    name = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", "o_orderdate", name.alias("name"), F.split("o_orderpriority", "-").alias("genres"))
    work = Node("Movie", "o_orderkey")
    return rejected(rows, Mapping((
        Type(work), Attr(work, "title", "name"), Link(work, "has_country", Node("Country", "name"), when=F.year("o_orderdate") > 1995),
        ForEach("genres", (Link(Node("Movie", "name"), "has_genre", Node("Genre", "$item")),)))))


def customer_graph(t):
    """Customers as people: the segment is the gender, the nation the profession."""
    person, nation = Node("Person", "c_custkey"), Node("Profession", "n_name")
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return VirtualGraph(
        Source(people, Mapping((Type(person), Attr(person, "gender", "c_mktsegment"),
                                Link(person, "primary_profession", nation))),
               (RDF_TYPE, "gender", "primary_profession")),
        Source(t.nation, Mapping((Type(nation), Attr(nation, "profession_name", "n_name"))), ("profession_name",)),
    )


@query(f"""SELECT {_iri('Person', 'c_custkey::VARCHAR')} AS person, c_mktsegment AS gender, n_name AS profession
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def bgp_match(t):
    return match(customer_graph(t), [
        ("?person", BASE + "gender", "?gender"),
        ("?person", BASE + "primary_profession", "?p"),
        ("?p", BASE + "profession_name", "?profession"),
    ]).drop("p")


@query("""SELECT n_name AS "professionName", c_mktsegment AS gender, count(*) AS count
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def bgp_group_count(t):
    return analytics.profession_gender_counts(customer_graph(t))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query('SELECT n_name AS "professionName", ' + ", ".join(
    f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in _SEGMENTS) +
    " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def profession_table(t):
    return analytics.profession_gender_table(analytics.profession_gender_counts(customer_graph(t)), list(_SEGMENTS))


def order_graph(t):
    """Orders as works, the part types of their items as genres.

    Items are made distinct on the plain keys before any IRI exists, so that shuffle is narrow.
    """
    work = Node("Movie", "o_orderkey")
    genre = Node("Genre", "p_type")
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    pairs = items.select("l_orderkey", "p_type").distinct()
    return VirtualGraph(
        Source(t.orders, Mapping((Type(work), Attr(work, "startYear", F.year("o_orderdate"), "integer"))),
               (RDF_TYPE, "startYear")),
        Source(pairs, Mapping((Link(Node("Movie", "l_orderkey"), "has_genre", genre),)), ("has_genre",)),
        Source(t.part, Mapping((Type(genre), Attr(genre, "genre_name", "p_type")))),
    )


_EVOLUTION = """WITH w AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, p_type AS "genreName", count(*) AS count
  FROM w JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) > 1900 GROUP BY ALL),
top AS (SELECT "genreName" FROM c GROUP BY "genreName" ORDER BY sum(count) DESC, "genreName" LIMIT 5)
"""


@query(_EVOLUTION + 'SELECT decade, "genreName", count FROM c')
def genre_evolution(t):
    return analytics.genre_evolution(order_graph(t))


@query(_EVOLUTION + 'SELECT decade, "genreName", count FROM c')
def stored_genre_evolution(t):
    """The same question of the graph stored by predicate: each pattern reads one folder, the rarest first."""
    path = work_path(t.spark, "graph")
    write_triples(order_graph(t).scan(), path)
    graph = read_table(t.spark, path)
    counts = predicate_counts(graph, [BASE + p for p in ("startYear", "has_genre", "genre_name")])
    return analytics.genre_evolution(graph, counts=counts, entailed=m.ontology())


@query(_EVOLUTION + 'SELECT decade, "genreName", count FROM c WHERE "genreName" IN (SELECT "genreName" FROM top)')
def decade_topk(t):
    """The flagship. Every work has its type from the same row as its year, so the pattern is implied."""
    counts = analytics.genre_evolution(order_graph(t), entailed=m.ontology())
    return analytics.top_genres(counts)


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(_EVOLUTION + "SELECT decade, " + ", ".join(
    f"coalesce(sum(count) FILTER (\"genreName\" = '{x}'), 0)::BIGINT AS \"{x}\"" for x in _TYPES) + " FROM c GROUP BY decade")
def genre_table(t):
    return analytics.genre_table(analytics.genre_evolution(order_graph(t), entailed=m.ontology()), list(_TYPES))


def _triple(s, p, o, kind="iri", datatype=None):
    return F.struct(s.cast("string").alias("s"), F.lit(BASE + p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
                    F.lit(datatype).cast("string").alias("o_datatype"))


def _node(cls, *key):
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return F.concat(F.lit(f"{BASE}{cls}/"), *[x for k in parts for x in (k, F.lit("_"))][:-1])


_RULES = {
    "subp": [("lives_in", "located_in"), ("based_in", "located_in"), ("part_of", "located_in")],
    "inv": [("located_in", "contains"), ("follows", "precedes")],
    "sym": ["trades_with"],
    "tra": ["located_in", "follows"],
    "dom": [("lives_in", "Customer"), ("based_in", "Supplier"), ("name", "Named"), ("follows", "Line")],
    "ran": [("part_of", "Region"), ("located_in", "Place")],
    "subc": [("Customer", "Person"), ("Person", "Agent"), ("Supplier", "Company"), ("Company", "Agent"), ("Region", "Place")],
}
_SCHEMA = plus.Schema(*[tuple(tuple(BASE + x for x in pair) for pair in _RULES[k]) for k in ("dom", "ran", "subc", "subp", "inv")],
                      *[tuple(BASE + x for x in _RULES[k]) for k in ("sym", "tra")])


def trade_graph(t):
    """Places, traders, the lines of an order in a row, and traders that are known under several names."""
    customer, supplier = _node("Customer", "c_custkey"), _node("Supplier", "s_suppkey")
    same = lambda a, b: _triple(a, "", b).withField("p", F.lit(plus.SAME))
    users = t.events.select("user_id").distinct().join(t.customer, F.col("user_id") == F.col("c_custkey"), "left_semi")
    doubles = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey"), "left_semi")
    numbers, before = F.array_sort(F.collect_set("l_linenumber")).alias("numbers"), F.col("l_linenumber") - 1
    lines = t.lineitem.filter("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(numbers)
    after = F.filter("numbers", lambda n, i: (i > 0) & (F.get("numbers", i - 1) == n - 1))
    lines = lines.select("l_orderkey", F.explode(after).alias("l_linenumber"))
    trades = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    parts = [
        t.customer.select(F.inline(F.array(_triple(customer, "lives_in", _node("Nation", "c_nationkey")),
                                           _triple(customer, "name", F.col("c_name"), "literal", XSD + "string")))),
        t.supplier.select(F.inline(F.array(_triple(supplier, "based_in", _node("Nation", "s_nationkey"))))),
        t.nation.select(F.inline(F.array(_triple(_node("Nation", "n_nationkey"), "part_of", _node("Region", "n_regionkey"))))),
        lines.select(F.inline(F.array(
            _triple(_node("Line", "l_orderkey", "l_linenumber"), "follows", _node("Line", "l_orderkey", before))))),
        trades.select(F.inline(F.array(_triple(_node("Customer", "o_custkey"), "trades_with", _node("Supplier", "l_suppkey"))))),
        users.select(F.inline(F.array(same(_node("User", "user_id"), _node("Customer", "user_id"))))),
        doubles.select(F.inline(F.array(same(_node("Customer", "s_suppkey"), supplier)))),
    ]
    return union_triples(*parts)


def _plus_sql():
    iri = lambda cls, key: f"'{BASE}{cls}/' || {key}"
    pairs = lambda k: ", ".join(f"('{BASE}{a}', '{BASE}{b}')" for a, b in _RULES[k])
    ones = lambda k: ", ".join(f"('{BASE}{a}')" for a in _RULES[k])
    lit = lambda s, p, o, frm: f"SELECT {s} AS s, '{p}' AS p, {o} AS o, 'iri' AS k, NULL::VARCHAR AS d FROM {frm}"
    base = " UNION ".join([
        lit(iri("Customer", "c_custkey"), BASE + "lives_in", iri("Nation", "c_nationkey"), "customer"),
        f"SELECT {iri('Customer', 'c_custkey')}, '{BASE}name', c_name, 'literal', '{XSD}string' FROM customer",
        lit(iri("Supplier", "s_suppkey"), BASE + "based_in", iri("Nation", "s_nationkey"), "supplier"),
        lit(iri("Nation", "n_nationkey"), BASE + "part_of", iri("Region", "n_regionkey"), "nation"),
        lit(iri("Line", "a.l_orderkey || '_' || a.l_linenumber"), BASE + "follows", iri("Line", "b.l_orderkey || '_' || b.l_linenumber"),
            "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1"),
        lit(iri("Customer", "o_custkey"), BASE + "trades_with", iri("Supplier", "l_suppkey"), "lineitem JOIN orders ON l_orderkey = o_orderkey"),
        lit(iri("User", "user_id"), plus.SAME, iri("Customer", "user_id"), "events WHERE user_id IN (SELECT c_custkey FROM customer)"),
        lit(iri("Customer", "s_suppkey"), plus.SAME, iri("Supplier", "s_suppkey"), "supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)"),
    ])
    return f"""WITH RECURSIVE subp(a, b) AS (VALUES {pairs('subp')}), inv(a, b) AS (VALUES {pairs('inv')}), sym(a) AS (VALUES {ones('sym')}),
tra(a) AS (VALUES {ones('tra')}), dom(a, b) AS (VALUES {pairs('dom')}), ran(a, b) AS (VALUES {pairs('ran')}), subc(a, b) AS (VALUES {pairs('subc')}),
base AS ({base}),
step AS (SELECT a, b, false AS f FROM subp UNION SELECT a, b, true FROM inv UNION SELECT b, a, true FROM inv UNION SELECT a, a, true FROM sym),
reach(a, b, f) AS (SELECT p, p, false FROM (SELECT p FROM base UNION SELECT a FROM step) UNION SELECT r.a, s.b, r.f <> s.f FROM reach r JOIN step s ON r.b = s.a),
one AS (SELECT DISTINCT CASE WHEN f THEN o ELSE s END AS s, b AS p, CASE WHEN f THEN s ELSE o END AS o, k, d
        FROM base JOIN reach ON p = a WHERE NOT f OR k = 'iri'),
near AS (SELECT s, o FROM one WHERE p = '{plus.SAME}' UNION SELECT o, s FROM one WHERE p = '{plus.SAME}'),
linked(s, o) AS (SELECT s, o FROM near UNION SELECT l.s, n.o FROM linked l JOIN near n ON l.o = n.s),
least AS (SELECT s, least(s, min(o)) AS r FROM linked GROUP BY s),
two AS (SELECT DISTINCT coalesce(a.r, x.s) AS s, p, coalesce(b.r, x.o) AS o, k, d FROM one x LEFT JOIN least a ON x.s = a.s
        LEFT JOIN least b ON x.o = b.s AND k = 'iri' WHERE p <> '{plus.SAME}'
        UNION SELECT s, '{plus.SAME}', r, 'iri', NULL FROM least WHERE s <> r),
path(p, s, o) AS (SELECT p, s, o FROM two JOIN tra ON p = a UNION SELECT path.p, path.s, t.o FROM path JOIN two t ON path.p = t.p AND path.o = t.s),
three AS (SELECT * FROM two UNION SELECT CASE WHEN f THEN o ELSE s END, b, CASE WHEN f THEN s ELSE o END, 'iri', NULL FROM path JOIN reach ON p = a),
up(a, b) AS (SELECT a, a FROM subc UNION SELECT b, b FROM subc UNION SELECT b, b FROM dom UNION SELECT b, b FROM ran
             UNION SELECT u.a, c.b FROM up u JOIN subc c ON u.b = c.a)
SELECT s, p, o, k AS o_kind, d AS o_datatype FROM three
UNION SELECT s, '{RDF_TYPE}', up.b, 'iri', NULL FROM three JOIN dom ON p = dom.a JOIN up ON dom.b = up.a
UNION SELECT o, '{RDF_TYPE}', up.b, 'iri', NULL FROM three JOIN ran ON p = ran.a JOIN up ON ran.b = up.a WHERE k = 'iri'"""


@query(_plus_sql())
def entail_plus(t):
    """Hierarchies, inverse, symmetric and transitive properties, and equal names over the trade graph."""
    return plus.entail_plus(trade_graph(t), _SCHEMA)


@query("""WITH RECURSIVE n AS (SELECT l_partkey AS s, l_suppkey + 1000000000 AS o FROM lineitem WHERE l_quantity > 49
  UNION SELECT l_suppkey + 1000000000, min(l_partkey) FROM lineitem GROUP BY l_suppkey),
w(s, o, steps) AS (SELECT s, o, 1 FROM n UNION SELECT w.s, n.o, w.steps + 1 FROM w JOIN n ON w.o = n.s WHERE w.steps < 40)
SELECT s, o, min(steps)::BIGINT AS steps FROM w GROUP BY s, o""")
def transitive_ways(t):
    """Parts lead to the suppliers that ship most of them, suppliers to their first part: ways with cycles."""
    big = F.col("l_suppkey") + 1000000000
    down = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("s"), big.alias("o"))
    back = t.lineitem.groupBy(big.alias("s")).agg(F.min("l_partkey").alias("o"))
    return transitive_closure(down.union(back))[0]


def _records_sql():
    rows = ", ".join(f"('{r['property']}', '{r['domain']}', '{r['range']}', {r['range_is_literal']})" for r in m.ontology())
    return f"(VALUES {rows}) ontology(property, domain, range, range_is_literal)"


@query(f"""WITH base AS ({_set(_TITLES, *TITLE_PARTS)})
SELECT property, domain, range, range_is_literal, count(base.s) AS triples FROM {_records_sql()} LEFT JOIN base ON base.p = property GROUP BY ALL""")
def ontology_frame(t):
    """The properties of the ontology with the number of triples that the titles have of each."""
    counts = set_of_triples((titles(t), m.titles_mapping())).groupBy("p").agg(F.count("*").alias("triples"))
    rows = ontology_rows(t.spark, m.ontology()).join(counts.withColumnRenamed("p", "property"), "property", "left")
    return rows.select("property", "domain", "range", "range_is_literal", F.coalesce("triples", F.lit(0)).alias("triples"))


def _buckets(subjects: int) -> int:
    """As many as keep a bucket at ``SUBJECTS_PER_BUCKET``, at least 8."""
    return max(8, -(-subjects // SUBJECTS_PER_BUCKET))


def title_star(t):
    """The graph of titles by subject, and a pattern of three properties of one title."""
    graph = set_of_triples((titles(t), m.titles_mapping()))
    path = work_path(t.spark, "by-subject")
    stored = write_graph_by_subject(graph, "graph_" + path[-32:], path, _buckets(t.orders.count()))
    return match(stored, [("?movie", BASE + p, f"?{name}") for p, name in (("title", "title"), ("startYear", "year"), ("has_genre", "genre"))])


@query(f"""WITH {_TITLES}, b AS ({" UNION ".join(TITLE_PARTS)}),
one AS (SELECT s, o FROM b WHERE p = '{BASE}title' AND s IS NOT NULL AND o IS NOT NULL), two AS (SELECT s, o FROM b WHERE p = '{BASE}startYear' AND o IS NOT NULL),
three AS (SELECT s, o FROM b WHERE p = '{BASE}has_genre' AND o IS NOT NULL)
SELECT one.s AS movie, one.o AS title, two.o AS year, three.o AS genre FROM one JOIN two USING (s) JOIN three USING (s)""")
def star_pattern(t):
    """Three properties of every title from a graph that is bucketed by subject: joins without an exchange."""
    return title_star(t)
