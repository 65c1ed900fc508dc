"""Type inference from property domains and ranges."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triples import COLUMNS, RDF_TYPE

MAX_PROPERTIES = 10_000


def rdfs_entail(triples: DataFrame, ontology: list[dict]) -> DataFrame:
    """The triples plus ``x a C`` for every property whose domain or class range says so.

    ``ontology`` is a list of ``{property, domain, range, range_is_literal}`` kept in the code,
    not a table that grows; its size is checked and it becomes two literal maps, so inference is
    a projection: each row gives itself and its types, so the input is read once. A property may have
    several domains and ranges. Without subclass or subproperty statements one pass is the fixpoint.
    ``triples`` may hold repeats: the one ``distinct`` at the end makes the set.
    """
    if len(ontology) > MAX_PROPERTIES:
        raise ValueError(f"ontology has {len(ontology)} properties, more than {MAX_PROPERTIES}")
    domains, ranges = defaultdict(list), defaultdict(list)
    for r in ontology:
        if r["domain"]:
            domains[r["property"]].append(r["domain"])
        if r["range"] and not r["range_is_literal"]:
            ranges[r["property"]].append(r["range"])
    is_iri = F.col("o_kind") == "iri"
    made = F.concat(
        F.array(F.struct(*COLUMNS)),
        F.transform(_lookup(domains), lambda c: _type(F.col("s"), c)),
        F.transform(F.when(is_iri, _lookup(ranges)).otherwise(F.array().cast("array<string>")), lambda c: _type(F.col("o"), c)),
    )
    return triples.select(F.inline(made)).distinct()


def _lookup(classes: dict[str, list[str]]):
    """The classes of the row's property, as an array."""
    none = F.array().cast("array<string>")
    if not classes:
        return none
    literal = F.create_map(*[x for p, cs in classes.items() for x in (F.lit(p), F.array(*map(F.lit, dict.fromkeys(cs))))])
    return F.coalesce(F.try_element_at(literal, F.col("p")), none)


def _type(subject, cls):
    return F.struct(subject.alias("s"), F.lit(RDF_TYPE).alias("p"), cls.alias("o"), F.lit("iri").alias("o_kind"),
                    F.lit(None).cast("string").alias("o_datatype"))
