"""Inference rules against a naive fixpoint, and reachability against a search."""

import random

import pytest

from lakegraph.operators import entail_plus as plus
from lakegraph.operators.closure import representatives, transitive_closure
from lakegraph.operators.triples import RDF_TYPE, SCHEMA

A = "http://x/"


def frame(spark, rows):
    return spark.createDataFrame([(s, p, o, k, d) for s, p, o, k, d in rows], SCHEMA)


def link(s, p, o):
    return (s, p, o, "iri", None)


def naive(rows, schema):
    """All rules again and again until nothing is new; equal terms by their smallest name."""
    facts = set(rows)
    while True:
        new = set()
        for s, p, o, k, d in facts:
            if None in (s, p, o):
                continue
            new |= {(s, b, o, k, d) for a, b in schema.sub_properties if a == p}
            new |= {link(s, RDF_TYPE, c) for a, c in schema.domains if a == p}
            if p == RDF_TYPE:
                new |= {link(s, RDF_TYPE, b) for a, b in schema.sub_classes if a == o}
            if k == "iri":
                new |= {link(o, RDF_TYPE, c) for a, c in schema.ranges if a == p}
                new |= {link(o, b, s) for a, b in schema.inverses if a == p} | {link(o, a, s) for a, b in schema.inverses if b == p}
                if p in schema.symmetric:
                    new.add(link(o, p, s))
                if p in schema.transitive:
                    new |= {link(s, p, z) for y, q, z, kk, _ in facts if (y, q, kk) == (o, p, "iri")}
        names = {}
        for s, p, o, k, _ in facts | new:
            if p == plus.SAME and k == "iri":
                names.setdefault(s, s), names.setdefault(o, o)
        changed = True
        while changed:
            changed = False
            for s, p, o, k, _ in facts | new:
                if p == plus.SAME and k == "iri" and names[s] != names[o]:
                    names[s] = names[o] = min(names[s], names[o])
                    changed = True
        out = {(names.get(s, s), p, names.get(o, o) if k == "iri" else o, k, d) for s, p, o, k, d in facts | new if (p, k) != (plus.SAME, "iri")}
        out |= {link(a, plus.SAME, b) for a, b in names.items() if a != b}
        if out == facts:
            return facts
        facts = out


@pytest.mark.parametrize("seed", range(3))
def test_rules_match_a_naive_fixpoint(spark, seed):
    rng = random.Random(seed)
    props, classes, nodes = [f"{A}p{i}" for i in range(7)], [f"{A}C{i}" for i in range(5)], [f"{A}n{i:02d}" for i in range(14)]
    pick = lambda xs, ys, n: tuple({(rng.choice(xs), rng.choice(ys)) for _ in range(n)})
    schema = plus.Schema(pick(props, classes, 3), pick(props, classes, 3), pick(classes, classes, 4), pick(props, props, 3),
                         pick(props, props, 2), (props[0],), (props[1], props[2]))
    rows = {link(rng.choice(nodes), rng.choice(props[:6]), rng.choice(nodes)) for _ in range(22)}
    rows |= {link(rng.choice(nodes), RDF_TYPE, rng.choice(classes)) for _ in range(4)}
    rows |= {(rng.choice(nodes), rng.choice(props), "text", "literal", "string") for _ in range(4)}
    rows |= {(rng.choice(nodes), plus.SAME, rng.choice(nodes), "iri", None) for _ in range(seed)}
    rows |= {(None, props[1], nodes[0], "iri", None)}
    got = {tuple(r) for r in plus.entail_plus(frame(spark, sorted(rows, key=str) * 2), schema).collect()}
    want = naive(rows, schema)
    # A term that is only the same as itself has nothing to say.
    assert got - {x for x in got if x[1] == plus.SAME and x[0] == x[2]} == want
    again = {tuple(r) for r in plus.entail_plus(frame(spark, sorted(got, key=str)), schema).collect()}
    assert again == got


def test_only_stated_triples_are_written(spark, monkeypatch):
    """What a property implies is put beside it at the end, also of a term that is related to itself."""
    written, store = {}, plus.stored
    monkeypatch.setattr(plus, "stored", lambda df, name, **k: written.setdefault(name, store(df, name, **k)))
    schema = plus.Schema(sub_properties=((A + "p", A + "q"),), inverses=((A + "q", A + "r"), (A + "r", A + "u")), symmetric=(A + "u",))
    rows = {link(A + "a", A + "p", A + "b"), link(A + "b", A + "r", A + "a"), link(A + "c", A + "u", A + "c"), link(A + "z", plus.SAME, A + "b")}
    out = [tuple(r) for r in plus.entail_plus(frame(spark, sorted(rows, key=str) * 2), schema).collect()]
    assert set(out) == naive(rows, schema) and len(out) == len(set(out))
    assert written and all(df.distinct().count() <= len(rows) for df in written.values())


@pytest.mark.parametrize("about", [plus.SAME, RDF_TYPE])
def test_rules_about_types_and_equality(spark, about):
    schema = plus.Schema(domains=((A + "p", A + "C"),), sub_classes=((A + "C", A + "D"),), sub_properties=((A + "p", about),))
    rows = {link(A + "a", A + "p", A + "C"), link(A + "b", A + "p", A + "a"), (A + "a", A + "p", "text", "literal", "string")}
    assert {tuple(r) for r in plus.entail_plus(frame(spark, sorted(rows, key=str)), schema).collect()} == naive(rows, schema)


def test_schema_from_triples(spark):
    rows = [link(A + "p", plus.SUB_PROPERTY, A + "q"), link(A + "q", plus.SUB_PROPERTY, A + "r"), link(A + "q", plus.DOMAIN, A + "C"),
            link(A + "C", plus.SUB_CLASS, A + "D"), link(A + "D", plus.EQUAL_CLASS, A + "E"), link(A + "r", plus.INVERSE, A + "s"),
            link(A + "t", RDF_TYPE, plus.TRANSITIVE), link(A + "a", A + "p", A + "b"), link(A + "a", A + "t", A + "b"), link(A + "b", A + "t", A + "c")]
    got = {tuple(r)[:3] for r in plus.entail_plus(frame(spark, rows)).collect()}
    want = {(A + "a", A + "q", A + "b"), (A + "a", A + "r", A + "b"), (A + "b", A + "s", A + "a"), (A + "a", RDF_TYPE, A + "C"),
            (A + "a", RDF_TYPE, A + "D"), (A + "a", RDF_TYPE, A + "E"), (A + "a", A + "t", A + "c"), (A + "p", plus.SUB_PROPERTY, A + "r")}
    assert want <= got and got == want | {x[:3] for x in rows}
    assert plus.entail_plus(frame(spark, [])).count() == 0


def test_names_of_equal_terms(spark):
    rows = [link("c", plus.SAME, "b"), link("b", plus.SAME, "a"), link("c", "p", "x"), link("y", "p", "b"), ("z", "p", "c", "literal", None)]
    out = plus.entail_plus(frame(spark, rows), plus.Schema())
    assert {tuple(r)[:4] for r in out.filter("p = 'p'").collect()} == {("a", "p", "x", "iri"), ("y", "p", "a", "iri"), ("z", "p", "c", "literal")}
    assert {tuple(r) for r in plus.all_names(out).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_rules_from_records():
    schema = plus.schema_of_records([{"property": "p", "domain": "C", "range": "D", "range_is_literal": False},
                                     {"property": "q", "domain": None, "range": "string", "range_is_literal": True}], inverses=(("p", "q"),))
    assert schema.classes_of_ends() == {"p": ({"C"}, {"D"}), "q": ({"D"}, {"C"})}
    with pytest.raises(ValueError):
        plus._table(None, [("a", "b")] * (plus.MAX_RULES + 1), "a string, b string")


def test_closure_finds_shortest_ways_in_few_rounds(spark):
    rng = random.Random(3)
    rows = [("x", i, i + 1) for i in range(70)] + [("y", rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    rows += [("y", 30, 30), ("x", None, 3), ("x", 4, None), rows[0]]
    got, rounds = transitive_closure(spark.createDataFrame(rows, "g string, s long, o long"), ("g",))
    want = {}
    for g in "xy":
        nodes = {n for h, *ends in rows for n in ends if h == g and n is not None}
        after = {n: {o for h, s, o in rows if (h, s) == (g, n) and o is not None} for n in nodes}
        for start in nodes:
            level, steps = after[start], 1
            while level:
                for n in level:
                    want[g, start, n] = steps
                steps += 1
                level = {m for n in level for m in after[n] if (g, start, m) not in want} - level
    assert {tuple(r)[:3]: r["steps"] for r in got.collect()} == want and got.count() == len(want)
    assert rounds <= 8
    assert transitive_closure(spark.createDataFrame([], "s long, o long"))[0].count() == 0


def test_representatives_of_long_chains_and_hubs(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)]
    random.Random(1).shuffle(chain)
    rows = chain + [("z0", f"z{i}") for i in range(1, 200)] + [("q", "q"), (None, "q"), chain[0]]
    got, rounds = representatives(spark.createDataFrame(rows, "s string, o string"))
    want = {n: "n000" for pair in chain for n in pair} | {f"z{i}": "z0" for i in range(200)} | {"q": "q"}
    assert {r["node"]: r["representative"] for r in got.collect()} == want and got.count() == len(want)
    assert rounds <= 15
