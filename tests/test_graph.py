import pytest
from pyspark.sql import functions as F

from lakegraph.operators import analytics
from lakegraph.operators.bgp import bgp_match, predicate_counts
from lakegraph.operators import triples as tr
from lakegraph.operators.entail import rdfs_entail
from lakegraph.operators.triples import (BASE, ITEM, RDF_TYPE, SCHEMA, XSD, Attr, ForEach, Link, Mapping, Node, Source, Type,
                                         VirtualGraph, encode_iri_part, merge_triples, only, rows_to_triples, set_of_triples, to_ntriples, union_triples)
from lakegraph.plans import movies as m


def _graph(spark, *rows):
    out = []
    for s, p, o in rows:
        kind, text = ("literal", o[1:]) if o.startswith("=") else ("iri", o)
        out.append((s, p, text, kind, XSD + "string" if kind == "literal" else None))
    return spark.createDataFrame(out, SCHEMA)


def test_iri_parts(spark):
    texts = ["plain", "Sci Fi", "a|b", "50%", "é", "x\ny", "\\N", "a+b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(encode_iri_part(F.col("t")))
    assert [r[0] for r in df.collect()] == ["plain", "Sci%20Fi", "a%7Cb", "50%25", "é", "x%0Ay", "%5CN", "a+b"]


def test_ntriples_escapes(spark):
    lines = to_ntriples(_graph(spark, ("s", "p", '=a"b\\c\nd\re\tf'), ("s", "p", "o"))).collect()
    assert lines[0][0] == '<s> <p> "a\\"b\\\\c\\nd\\re\\tf"^^<' + XSD + 'string> .'
    assert lines[1][0] == "<s> <p> <o> ."


def test_missing_values_make_no_triple(spark):
    df = spark.createDataFrame([("tt1", None, ["x", None, ""]), ("tt2", 1990, None), (None, 1, ["y"])],
                               "k string, y int, g array<string>")
    node = Node("Movie", "k")
    mapping = Mapping((Type(node), Attr(node, "startYear", "y", "integer"),
                       ForEach("g", (Link(node, "has_genre", Node("Genre", ITEM)),))))
    got = {(r["s"], r["p"], r["o"]) for r in rows_to_triples(df, mapping).collect()}
    movie = BASE + "Movie/"
    assert got == {(movie + "tt1", RDF_TYPE, BASE + "Movie"), (movie + "tt2", RDF_TYPE, BASE + "Movie"),
                   (movie + "tt1", BASE + "has_genre", BASE + "Genre/x"), (movie + "tt2", BASE + "startYear", "1990")}


def test_the_same_triple_of_two_tables_collapses(spark):
    df = spark.createDataFrame([("tt1", "A")], "movie_id string, movie_title string").withColumn("genres", F.array(F.lit("x")))
    other = df.withColumn("movie_title", F.lit("B"))
    merged = merge_triples(rows_to_triples(df, m.movies_mapping()), rows_to_triples(other, m.movies_mapping()))
    assert merged.count() == 7 and merged.filter(F.col("p") == BASE + "title").count() == 2


def test_mappings_stay_in_compiled_code(spark):
    df = spark.createDataFrame([("nm1", "A", 1900, None, ["x"], ["tt1"])],
                               "nconst string, primaryName string, birthYear int, deathYear int, primaryProfession array<string>, knownForTitles array<string>")
    plan = rows_to_triples(df, m.people_mapping())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_pruned_mapping_reads_only_its_columns(spark, tmp_path):
    spark.createDataFrame([("tt1", "A", 1, 2)], "tconst string, primaryTitle string, startYear int, runtimeMinutes int") \
        .withColumn("genres", F.array(F.lit("x"))).write.parquet(str(tmp_path / "t"))
    graph = VirtualGraph(Source(spark.read.parquet(str(tmp_path / "t")), m.titles_mapping(), ("startYear",)))
    plan = graph.scan(BASE + "startYear")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tconst:string,startYear:int>" in plan and "Exchange" not in plan
    assert only(m.titles_mapping(), ["nothing"]).steps == ()
    assert graph.scan("nothing").count() == 0
    assert graph.scan().count() == 8


def test_a_stored_graph_is_read_by_predicate(spark, tmp_path):
    from lakegraph.sources.sinks import write_triples
    write_triples(_graph(spark, ("a", "p", "b"), ("a", "q", "c")), str(tmp_path / "g"))
    graph = spark.read.parquet(str(tmp_path / "g"))
    match = bgp_match(graph, [("?x", "p", "?y")])
    assert match.collect() == [("a", "b")]
    assert "PartitionFilters: [isnotnull(p" in match._jdf.queryExecution().executedPlan().toString()


def test_a_hub_is_not_gathered(spark, tmp_path, monkeypatch):
    """A pattern counted small is broadcast whatever Spark thinks of its files; otherwise the larger side streams. Nothing is sorted to be written."""
    from lakegraph.operators import bgp
    from lakegraph.sources.sinks import write_triples
    rows = [(f"m{i}", "has_genre", f"g{i % 2}") for i in range(20)] + [("g0", "genre_name", "=A"), ("g1", "genre_name", "=B")]
    rows += [(f"m{i}", "year", "=1990") for i in range(0, 20, 2)]
    write_triples(_graph(spark, *rows), str(tmp_path / "g"))
    graph = spark.read.parquet(str(tmp_path / "g"))
    patterns = [("?m", "has_genre", "?g"), ("?g", "genre_name", "?n"), ("?m", "year", "?y")]
    counts = predicate_counts(graph, [p for _, p, _ in patterns])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted((f"m{i}", "g0", "A", "1990") for i in range(0, 20, 2))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, small, large in ((10, 2, 0), (0, 0, 2)):
            monkeypatch.setattr(bgp, "FEW_TRIPLES", few)
            found = bgp_match(graph, patterns, counts=counts)
            assert plan(found).count("BroadcastHashJoin") == small and plan(found).count("SortMergeJoin") == large
            assert sorted(tuple(r) for r in found.collect()) == want
        first = plan(found).split("SortMergeJoin")[-1]
        assert 0 < first.index("has_genre") < first.index("genre_name")  # the right side's rows of a key are held
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_all_triples_of_a_virtual_graph_are_a_set(spark):
    """Repeated rows, a null key and a node of two sources; what is shuffled are the keys, not the IRIs."""
    works = spark.createDataFrame([(1, 1990), (1, 1990), (2, None), (None, 1991)], "k int, y int")
    kinds = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "k int, g string")
    work, genre = Node("Movie", "k"), Node("Genre", "g")
    graph = VirtualGraph(Source(works, Mapping((Type(work), Attr(work, "startYear", "y", "integer"))), (RDF_TYPE, "startYear")),
                         Source(kinds, Mapping((Link(work, "has_genre", genre), Attr(genre, "genre_name", "g")))))
    every = merge_triples(*[rows_to_triples(s.table, s.mapping) for s in graph.sources])
    assert sorted(map(str, graph.scan().collect())) == sorted(map(str, every.collect())) and graph.scan().count() == 6
    plan = graph.scan()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not any(BASE in x for x in plan.split("\n") if "Exchange" in x) and "hashpartitioning(s#" not in plan


def test_entailment(spark):
    graph = _graph(spark, ("u", BASE + "rates_movie", "r"), ("r", BASE + "rating_movie", "f"), ("f", BASE + "title", "=T"),
                   ("x", "unknown", "y"))
    once = rdfs_entail(graph, m.ontology())
    types = {(r["s"], r["o"].removeprefix(BASE)) for r in once.filter(F.col("p") == RDF_TYPE).collect()}
    assert types == {("u", "User"), ("r", "Rating"), ("f", "Movie")}
    assert sorted(rdfs_entail(once, m.ontology()).collect()) == sorted(once.collect())
    assert rdfs_entail(graph.limit(0), m.ontology()).count() == 0


def test_ontology(spark):
    from lakegraph.sources.readers import ontology_frame
    df = ontology_frame(spark, m.ontology())
    assert df.count() == 27 and df.filter("range_is_literal").count() == 17
    assert df.select("domain").distinct().count() == 8


def test_patterns(spark):
    graph = _graph(spark, ("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "c"), ("a", "name", "=x"), ("b", "name", "=x"),
                   ("c", "name", "=b"), ("a", "likes", "=b"))
    rows = lambda *patterns, **k: sorted(tuple(r) for r in bgp_match(graph, list(patterns), **k).collect())
    assert rows(("?x", "knows", "?y"), ("?y", "knows", "?z")) == [("a", "b", "c"), ("b", "c", "c"), ("c", "c", "c")]
    assert rows(("?x", "knows", "?x")) == [("c",)]
    assert rows(("a", "?p", "?o")) == [("knows", "b"), ("likes", "b"), ("name", "x")]
    assert rows(("?x", "name", "?n"), ("?y", "name", "?n"), ("?x", "knows", "?y")) == [("a", "x", "b"), ("c", "b", "c")]
    # The literal "b" is not the resource b.
    assert rows(("?x", "likes", "?y"), ("?y", "knows", "?z")) == []
    counts = predicate_counts(graph, ["knows", "name", "likes", "none"])
    assert counts == {"knows": 3, "name": 3, "likes": 1, "none": 0}
    assert rows(("?x", "name", "?n"), ("?x", "likes", "?l"), counts=counts) == [("a", "x", "b")]
    with pytest.raises(ValueError):
        bgp_match(graph, [("?x", "knows", "?y"), ("?a", "name", "?b")])


def test_a_literal_and_a_resource_of_one_text_do_not_meet(spark):
    graph = _graph(spark, ("a", "p", "=v"), ("b", "q", "v"), ("c", "q", "=v"))
    assert bgp_match(graph, [("?x", "p", "?o"), ("?y", "q", "?o")]).collect() == [("a", "v", "c")]


def test_implied_types_are_left_out(spark):
    graph = _graph(spark, ("f", BASE + "startYear", "=1990"))
    patterns = [("?m", RDF_TYPE, BASE + "Movie"), ("?m", BASE + "startYear", "?y")]
    assert bgp_match(graph, patterns).count() == 0
    assert bgp_match(graph, patterns, entailed=m.ontology()).collect() == [("f", "1990")]


def test_top_genres_breaks_ties_by_name(spark):
    counts = spark.createDataFrame([(1990, g, 1) for g in "gfedcba"] + [(2000, "g", 5)], "decade int, genreName string, count long")
    top = analytics.top_genres(counts)
    assert sorted({r["genreName"] for r in top.collect()}) == ["a", "b", "c", "d", "g"]
    table = analytics.genre_table(top).orderBy("decade").collect()
    assert table[1]["g"] == 5 and table[1]["a"] == 0


def test_person_without_profession_is_not_counted(spark):
    graph = _graph(spark, ("p", RDF_TYPE, BASE + "Person"), ("p", BASE + "gender", "=Male"))
    assert analytics.profession_gender_counts(graph).count() == 0


def test_every_domain_and_range_counts(spark):
    ontology = [{"property": "p", "domain": d, "range": r, "range_is_literal": False} for d, r in (("A", "X"), ("B", "Y"), ("A", "X"))]
    one = spark.createDataFrame([("s", "p", "o", "iri", None)] * 2, "s string, p string, o string, o_kind string, o_datatype string")
    got = {(r["s"], r["o"]) for r in rdfs_entail(one, ontology).collect()}
    assert got == {("s", "o"), ("s", "A"), ("s", "B"), ("o", "X"), ("o", "Y")}
    assert rdfs_entail(one, []).collect() == [("s", "p", "o", "iri", None)]


def test_rejected_triples_are_those_not_made(spark):
    df = spark.createDataFrame([("a", "x", ["1", "", "2"]), ("b", None, ["1"]), (None, "y", ["1", "2", None]), (None, None, None)],
                               "k string, v string, l array<string>")
    node = tr.Node("Movie", "k")
    mapping = tr.Mapping((tr.Type(node), tr.Attr(node, "title", "v"), tr.Attr(node, "some", "v", when=F.col("k") == "b"), tr.ForEach("l", (
        tr.Link(node, "all", tr.Node("Genre", tr.ITEM)), tr.Link(node, "first", tr.Node("Genre", tr.ITEM), "first"),
        tr.Link(node, "rest", tr.Node("Genre", tr.ITEM), "rest"), tr.Type(tr.Node("Genre", tr.ITEM))))))
    got = {r["p"].split("/")[-1].split("#")[-1]: r["rejected"] for r in tr.rejected_triples(df, mapping).collect()}
    assert got == {"type": 2, "title": 3, "some": 1, "all": 2, "first": 1, "rest": 1}
    assert {r["rejected"] for r in tr.rejected_triples(df.limit(0), mapping).collect()} == {0}


def test_sets_by_keys_are_sets_of_triples(spark):
    """Repeats within and between tables, keys that need encoding, nulls, lists, and prefixes that cannot be told apart."""
    rows = [("a b", "t", ["x", "y", None, ""], 1), ("a b", "t", ["x"], 1), ("c", None, None, None), (None, "t", ["x"], 2), ("é/d", "a b", [], 3)]
    df = spark.createDataFrame(rows, "k string, v string, xs array<string>, n int")
    work, genre = Node("Movie", "k"), Node("Genre", "$item")
    one = Mapping((Type(work), Attr(work, "title", "v"), Attr(work, "n", "n", "integer", when=F.col("n") < 3), Link(work, "same", Node("Movie", "v")),
                   ForEach("xs", (Type(genre), Link(work, "first_genre", genre, position="first"), Attr(genre, "name", "$item")))))
    two = Mapping((Type(Node("Movie", "v")), Attr(Node("Movie", "v"), "title", "k")))
    nested = Mapping((Link(Node("Movie/x", "k"), "same", Node("Movie", "v")),))
    ontology = [{"property": BASE + p, "domain": BASE + d, "range": r and BASE + r, "range_is_literal": literal} for p, d, r, literal in (
        ("title", "Movie", "string", True), ("same", "Work", "Other", False), ("first_genre", "Movie", "Genre", False), ("name", "Genre", None, False))]
    for sources in ([(df, one)], [(df, one), (df, two)], [(df, two), (df.limit(2), nested)], [(df.limit(0), one)], [(df, Mapping(()))]):
        plain = union_triples(*[rows_to_triples(x, m) for x, m in sources])
        assert sorted(set_of_triples(*sources).collect(), key=str) == sorted(plain.distinct().collect(), key=str)
        assert sorted(set_of_triples(*sources, ontology=ontology).collect(), key=str) == sorted(rdfs_entail(plain, ontology).collect(), key=str)


def test_star_joins_need_no_exchange(spark, tmp_path):
    from lakegraph.sources.sinks import write_graph_by_subject
    rows = [(f"m{i}", f"p{j}", str(i * j), "literal", "string") for i in range(300) for j in range(3) if (i + j) % 5]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        graph = write_graph_by_subject(spark.createDataFrame(rows, SCHEMA), "star_test", str(tmp_path / "star"), 4)
        star = bgp_match(graph, [("?m", "p0", "?a"), ("?m", "p1", "?b"), ("?m", "p2", "?c")])
        plan = star._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        want = {(f"m{i}", "0", str(i), str(2 * i)) for i in range(300) if all((i + j) % 5 for j in range(3))}
        assert {tuple(r) for r in star.select("m", "a", "b", "c").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_facts_are_fewer_than_triples(spark):
    """Triples of the same values are dropped as one, also across tables; keys that read in two ways stay apart."""
    rows = [("u", "tt1", 3, "2000"), ("u", "tt1", 3, "2001"), ("u", "tt1", 3, "2001"), ("u_tt1", "tt2", 1, "x"), ("u", "tt1_tt2", 1, "x"),
            ("u", "tt1_tt2", 2, "x"), (None, "tt3", 1, "x"), ("v w", "tt4", None, "x"), ("v w", "no", 5, "x")]
    one = spark.createDataFrame(rows, "user_id string, movie_id string, rating int, rating_timestamp string")
    two = spark.createDataFrame([("tt1", "T", 1990), ("tt1", "T", None), ("a b", "_", 1)], "movie_id string, title string, year int")
    key, other = Node("Movie", "movie_id"), Node("Movie", "title")
    titles = Mapping((Type(key), Attr(key, "title", "title"), Attr(key, "startYear", "year", "integer"), Link(other, "rates_movie", key),
                      Type(Node("Rating", "title", "year")), Type(Node("Rating", "title"))))
    sources = ((one, m.ratings_mapping()), (two, titles))
    for some in (sources[:1], sources, sources[::-1]):
        plain = union_triples(*[rows_to_triples(*x) for x in some])
        for ontology in (None, m.ontology()):
            found = [tuple(r) for r in set_of_triples(*some, ontology=ontology).collect()]
            want = {tuple(r) for r in (rdfs_entail(plain, ontology) if ontology else plain).collect()}
            assert len(found) == len(set(found)) and set(found) == want
    plan = tr._Plan([])
    opened, groups = tr._opened(*sources[0])
    plan.add(opened, groups, BASE)
    plan.settle()
    facts = plan.facts(0, opened, groups, tr._COMPOSITE) + plan.facts(0, opened, groups, tr._SIMPLE)
    clean = "rating is not null and movie_id = 'tt1'"
    assert sum(x.filter("k0 = 'u' AND k1 IS NOT NULL AND k1 = 'tt1'").count() for x in facts) == 3 * one.filter(clean).count()
    assert rows_to_triples(one.filter(clean), m.ratings_mapping()).count() == 8 * one.filter(clean).count()


def test_buckets_follow_the_titles(spark):
    from lakegraph.catalog import graph
    assert graph._buckets(10) == 8 and graph._buckets(100 * graph.SUBJECTS_PER_BUCKET + 1) == 101


def test_facts_of_two_values_are_dealt_before_they_are_combined(spark):
    df = spark.createDataFrame([("tt1", "A", 1990, 90, ["x"]), ("tt1", "A", 1990, 90, ["x"]), ("tt1", "B", None, 90, ["x", "y"])],
                               "tconst string, primaryTitle string, startYear int, runtimeMinutes int, genres array<string>")
    found = tr.set_of_triples((df, m.titles_mapping()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, rows_to_triples(df, m.titles_mapping()).distinct().collect()))
