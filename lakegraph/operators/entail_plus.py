"""Inference with class and property hierarchies, inverse, symmetric and transitive properties, and equal terms.

What the schema says is closed first: which properties a property implies, in which direction, and
which classes follow for the two ends. That is a small table, so all rules but two are one pass over the
triples. The two that need more than one triple run as fixpoints of their own over what they concern:
equal terms are connected components, transitive properties a semi-naive closure.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import representatives, transitive_closure
from .ordering import stored
from .triples import COLUMNS, RDF_TYPE

log = logging.getLogger(__name__)

# The vocabulary of schemas.
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
INVERSE, SAME, SYMMETRIC, TRANSITIVE = OWL + "inverseOf", OWL + "sameAs", OWL + "SymmetricProperty", OWL + "TransitiveProperty"
EQUAL_CLASS, EQUAL_PROPERTY = OWL + "equivalentClass", OWL + "equivalentProperty"

# A schema is code, not data: more statements, or more that follow from them, are an error.
MAX_STATEMENTS, MAX_RULES = 20_000, 200_000


@dataclass(frozen=True)
class Schema:
    """Statements of a schema as pairs of IRIs; ``symmetric`` and ``transitive`` are properties."""

    domains: tuple = ()
    ranges: tuple = ()
    sub_classes: tuple = ()
    sub_properties: tuple = ()
    inverses: tuple = ()
    symmetric: tuple = ()
    transitive: tuple = ()

    def implied(self, literal: bool = False) -> dict[str, set[tuple[str, bool]]]:
        """For each property, the properties that a triple of it implies; True: with its ends exchanged.

        ``literal``: of a triple whose object is a literal, which cannot be exchanged even on the way.
        """
        edges: dict[tuple[str, bool], set[tuple[str, bool]]] = defaultdict(set)
        for turned in (False, True):
            for a, b in self.sub_properties:
                edges[a, turned].add((b, turned))
            for a, b in () if literal else self.inverses:
                edges[a, turned].add((b, not turned))
                edges[b, turned].add((a, not turned))
            for a in () if literal else self.symmetric:
                edges[a, turned].add((a, not turned))
        starts = {p for p, _ in edges} | {p for p, _ in (*self.domains, *self.ranges)}
        return {p: _reached(edges, (p, False)) for p in starts}

    def mutual(self) -> dict[str, set[tuple[str, bool]]]:
        """For each property, those it implies and that imply it, itself included; True: with its ends exchanged."""
        implied = self.implied()
        return {p: {(q, turned) for q, turned in qs if (p, turned) in implied.get(q, {(q, False)})} for p, qs in implied.items()}

    def mentions(self) -> set[str]:
        """The properties that some rule is about."""
        pairs = {p for p, _ in (*self.domains, *self.ranges)} | {p for pair in (*self.sub_properties, *self.inverses) for p in pair}
        return pairs | {*self.symmetric, *self.transitive}

    def super_classes(self) -> dict[str, set[str]]:
        edges: dict[str, set[str]] = defaultdict(set)
        for a, b in self.sub_classes:
            edges[a].add(b)
        return {c: _reached(edges, c) - {c} for c in list(edges)}

    def classes_of_ends(self, literal: bool = False) -> dict[str, tuple[set[str], set[str]]]:
        """For each property, the classes of its subject and of its object."""
        above, domains, ranges = self.super_classes(), defaultdict(set), defaultdict(set)
        for out, statements in ((domains, self.domains), (ranges, self.ranges)):
            for p, c in statements:
                out[p] |= {c} | above.get(c, set())
        found = {}
        for p, implied in self.implied(literal).items():
            ends: tuple[set[str], set[str]] = (set(), set())
            for q, turned in implied:
                ends[turned].update(domains.get(q, ()))
                ends[not turned].update(ranges.get(q, ()))
            if ends[0] or ends[1]:
                found[p] = ends
        return found


def _reached(edges: dict, start) -> set:
    seen, open_ = {start}, [start]
    while open_:
        for node in edges.get(open_.pop(), ()):
            if node not in seen:
                seen.add(node)
                open_.append(node)
    return seen


def schema_of_records(ontology: Iterable[dict], **more) -> Schema:
    """A schema of ``{property, domain, range, range_is_literal}`` records and further statements."""
    ontology = list(ontology)
    return Schema(domains=tuple((r["property"], r["domain"]) for r in ontology if r["domain"]),
                  ranges=tuple((r["property"], r["range"]) for r in ontology if r["range"] and not r["range_is_literal"]), **more)


def schema_of_triples(triples: DataFrame) -> Schema:
    """The schema that the triples themselves state; equivalences count as both directions."""
    pairs = (SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, INVERSE, EQUAL_CLASS, EQUAL_PROPERTY)
    told = triples.filter(F.col("p").isin(*pairs) | (F.col("p") == RDF_TYPE) & F.col("o").isin(SYMMETRIC, TRANSITIVE))
    rows = told.filter("o_kind = 'iri'").select("s", "p", "o").distinct().limit(MAX_STATEMENTS + 1).collect()
    if len(rows) > MAX_STATEMENTS:
        raise ValueError(f"the schema has more than {MAX_STATEMENTS} statements")
    of = lambda p: tuple(sorted((r["s"], r["o"]) for r in rows if r["p"] == p))
    both = lambda p: of(p) + tuple((b, a) for a, b in of(p))
    kind = lambda c: tuple(sorted(r["s"] for r in rows if r["p"] == RDF_TYPE and r["o"] == c))
    return Schema(of(DOMAIN), of(RANGE), of(SUB_CLASS) + both(EQUAL_CLASS), of(SUB_PROPERTY) + both(EQUAL_PROPERTY), of(INVERSE),
                  kind(SYMMETRIC), kind(TRANSITIVE) + (SUB_CLASS, SUB_PROPERTY))


def entail_plus(triples: DataFrame, schema: Schema | None = None) -> DataFrame:
    """The set of triples with all that follow from ``schema`` (None: the one the triples state).

    Rules: sub-properties, inverse, symmetric and transitive properties, domains, ranges, sub-classes, and
    equal terms. Of terms that are equal the smallest IRI stands for all of them in every triple, and
    each of the others keeps one ``sameAs`` triple to it; ``all_names`` gives the rest when it is asked for.
    Literals are never subjects, so they have no inverse and no class. Applying it again adds nothing. No
    triples give no triples; triples with a null part imply nothing and stay as they are.
    """
    schema = schema_of_triples(triples) if schema is None else schema
    links = _links(triples.sparkSession, schema)
    if schema.mentions() & {RDF_TYPE, SAME}:
        return _in_full(triples, schema, links)
    # Only stated triples are written and renamed; what a property implies is the same before and after.
    stated = stored(triples.select(*COLUMNS), "stated", compression="zstd")
    equal = (F.col("p") == SAME) & (F.col("o_kind") == "iri") & (F.col("s") != F.col("o"))
    if stated.filter(equal).head(1):
        names, rounds = representatives(stated.filter(equal).select("s", "o"))
        log.info("equal terms: %d rounds", rounds)
        stated = stored(_renamed(stated, names), "renamed", compression="zstd")
    typing = F.coalesce((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri") & F.col("o_datatype").isNull()
                        & F.col("s").isNotNull() & F.col("o").isNotNull(), F.lit(False))
    every = stated.filter(~typing)
    if schema.transitive:
        edges = _with_implied(stated, links).filter(F.col("p").isin(*schema.transitive) & (F.col("o_kind") == "iri")).select("p", "s", "o")
        reached, rounds = transitive_closure(edges, ("p",))
        log.info("transitive properties: %d rounds", rounds)
        every = every.unionByName(_onward(reached))
    return _told_once(every, schema).unionByName(_types(stated, stated.filter(typing), schema))


def _in_full(triples: DataFrame, schema: Schema, links: DataFrame) -> DataFrame:
    """The same with every implied triple written out: for schemas with rules about types or equality themselves."""
    every = stored(_with_implied(triples.select(*COLUMNS), links), "implied")

    pairs = every.filter((F.col("p") == SAME) & (F.col("o_kind") == "iri") & (F.col("s") != F.col("o"))).select("s", "o")
    if pairs.head(1):
        names, rounds = representatives(pairs)
        log.info("equal terms: %d rounds", rounds)
        every = stored(_renamed(every, names), "renamed")
    if schema.transitive:
        edges = every.filter(F.col("p").isin(*schema.transitive) & (F.col("o_kind") == "iri")).select("p", "s", "o")
        reached, rounds = transitive_closure(edges, ("p",))
        log.info("transitive properties: %d rounds", rounds)
        every = every.unionByName(_with_implied(_onward(reached), links))
    return _with_types(every, schema).distinct()


def _onward(reached: DataFrame) -> DataFrame:
    """Triples of the ways of more than one step."""
    return reached.filter("steps > 1").select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))


def _told_once(triples: DataFrame, schema: Schema) -> DataFrame:
    """The set of triples with all that properties imply.

    Properties that imply each other say the same, as a property and its inverse do. Only the first of them is made
    distinct, a symmetric one with its ends in order, and the others are put beside it afterwards.
    """
    spark, mutual = triples.sparkSession, schema.mutual()
    first = {p: min(qs) for p, qs in mutual.items()}
    either = {p for p, qs in mutual.items() if (p, True) in qs}
    told = set()
    for literal in (False, True):
        for p, qs in schema.implied(literal).items():
            for q, turned in qs:
                to, back = (q, False) if literal else first.get(q, (q, False))
                told.add((p, literal, to, turned != back and to not in either, not literal and to in either))
    rules = _table(spark, sorted(told), "_p string, _literal boolean, q string, turned boolean, either boolean")
    turned, either_ = F.coalesce("turned", F.lit(False)), F.coalesce("either", F.lit(False))
    least, greatest = F.least("s", "o"), F.greatest("s", "o")
    once = _keyed(triples).join(rules, ["_p", "_literal"], "left").select(
        F.when(either_, least).when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("q", "p").alias("p"),
        F.when(either_, greatest).when(turned, F.col("s")).otherwise(F.col("o")).alias("o"), "o_kind", "o_datatype").distinct()
    again = [(p, False, q, turned) for p, qs in mutual.items() if first[p] == (p, False) for q, turned in sorted(qs)]
    out = _keyed(once).join(_table(spark, again, "_p string, _literal boolean, q string, turned boolean"), ["_p", "_literal"], "left")
    # A term that is related to itself is the same with its ends exchanged.
    out = out.filter(~(turned & F.coalesce(F.col("_p").isin(*sorted(either)), F.lit(False)) & (F.col("s") == F.col("o")))) if either else out
    return out.select(
        F.when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("q", "p").alias("p"),
        F.when(turned, F.col("s")).otherwise(F.col("o")).alias("o"), "o_kind", "o_datatype")


def _types(triples: DataFrame, typing: DataFrame, schema: Schema) -> DataFrame:
    """The set of type triples: stated ones, the classes above them, and those of the ends of all triples.

    Ways of a transitive property end where its steps do, so they add no class.
    """
    spark = triples.sparkSession
    ends = _table(spark, _classes(schema), "_p string, _literal boolean, c string, of_object boolean")
    above = [(c, d) for c, ds in schema.super_classes().items() for d in sorted(ds)]
    found = _keyed(triples).join(ends, ["_p", "_literal"]).select(F.when(F.col("of_object"), F.col("o")).otherwise(F.col("s")).alias("s"), "c")
    stated = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri") & F.col("s").isNotNull())
    more = stated.join(_table(spark, above, "o string, d string"), "o").select("s", F.col("d").alias("c"))
    return found.union(more).union(typing.select("s", "o")).distinct().select(
        "s", F.lit(RDF_TYPE).alias("p"), F.col("c").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))


def all_names(triples: DataFrame) -> DataFrame:
    """(name, representative) of every term that has another name, itself included, from entailed triples."""
    same = triples.filter((F.col("p") == SAME) & (F.col("o_kind") == "iri"))
    return same.select(F.col("s").alias("name"), F.col("o").alias("representative")).union(same.select("o", "o")).distinct()


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Rules of the schema: small by their checked number."""
    if len(rows) > MAX_RULES:
        raise ValueError(f"{len(rows)} rules follow from the schema, more than {MAX_RULES}")
    return F.broadcast(spark.createDataFrame(rows, schema))


def _keyed(triples: DataFrame) -> DataFrame:
    """Triples with what rules are looked up by; a triple with a null part has no rules."""
    whole = F.col("s").isNotNull() & F.col("o").isNotNull()
    return triples.select(*COLUMNS, F.when(whole, F.col("p")).alias("_p"), (F.col("o_kind") != "iri").alias("_literal"))


def _links(spark, schema: Schema) -> DataFrame:
    """(_p, _literal, q, turned): what a property implies, itself included."""
    rows = [(p, literal, q, turned) for literal in (False, True) for p, qs in schema.implied(literal).items()
            for q, turned in sorted(qs)]
    return _table(spark, rows, "_p string, _literal boolean, q string, turned boolean")


def _with_implied(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Every triple and those of the properties it implies: one pass, a triple without rules gives itself."""
    turned = F.coalesce("turned", F.lit(False))
    return _keyed(triples).join(links, ["_p", "_literal"], "left").select(
        F.when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("q", "p").alias("p"),
        F.when(turned, F.col("s")).otherwise(F.col("o")).alias("o"), "o_kind", "o_datatype")


def _renamed(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples over representatives, with one statement that ties each other name to its own."""
    one = names.select(F.col("node").alias("s"), F.col("representative").alias("_s"))
    two = names.select(F.col("node").alias("o"), F.col("representative").alias("_o"))
    out = triples.filter((F.col("p") != SAME) | (F.col("o_kind") != "iri")).join(one, "s", "left")
    out = out.join(two.withColumn("o_kind", F.lit("iri")), ["o", "o_kind"], "left")
    out = out.select(F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o"), "o_kind", "o_datatype")
    ties = names.filter("node <> representative").select(
        F.col("node").alias("s"), F.lit(SAME).alias("p"), F.col("representative").alias("o"), F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"))
    return out.unionByName(ties)


def _classes(schema: Schema) -> list[tuple[str, bool, str, bool]]:
    """(property, of a literal, class, of the object) of the ends that have a class."""
    return [(p, literal, c, i == 1) for literal in (False, True) for p, both in schema.classes_of_ends(literal).items()
            for i in (0, 1) if not (literal and i) for c in sorted(both[i])]


def _with_types(triples: DataFrame, schema: Schema) -> DataFrame:
    """Every triple, the classes of its ends, and the classes above a stated one."""
    spark = triples.sparkSession
    ends = _classes(schema)
    own = sorted({(p, literal, None, False) for p, literal, *_ in ends})
    ends = _table(spark, own + ends, "_p string, _literal boolean, c string, of_object boolean")
    above = [(c, d) for c, ds in schema.super_classes().items() for d in sorted(ds)]
    made = F.col("c").isNotNull()
    out = _keyed(triples).join(ends, ["_p", "_literal"], "left").select(
        F.when(F.col("of_object"), F.col("o")).otherwise(F.col("s")).alias("s"), F.when(made, RDF_TYPE).otherwise(F.col("p")).alias("p"),
        F.coalesce("c", "o").alias("o"), F.when(made, "iri").otherwise(F.col("o_kind")).alias("o_kind"),
        F.when(~made, F.col("o_datatype")).alias("o_datatype"))
    stated = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri") & F.col("s").isNotNull())
    more = stated.join(_table(spark, above, "o string, d string"), "o").select("s", "p", F.col("d").alias("o"), "o_kind", "o_datatype")
    return out.unionByName(more)
