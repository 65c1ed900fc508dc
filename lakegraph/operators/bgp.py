"""Conjunctive triple patterns as joins on shared variables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triples import RDF_TYPE, VirtualGraph

# A pattern counted to have no more triples is sent whole to every task.
FEW_TRIPLES = 10_000


def predicate_counts(triples: DataFrame, predicates: list[str]) -> dict[str, int]:
    """Triples per named predicate; the result has at most ``len(predicates)`` entries."""
    rows = triples.filter(F.col("p").isin(*predicates)).groupBy("p").count().collect()
    return {**{p: 0 for p in predicates}, **{r["p"]: r["count"] for r in rows}}


def bgp_match(graph: DataFrame | VirtualGraph, patterns: list[tuple[str, str, str]],
              counts: dict[str, int] | None = None, entailed: list[dict] | None = None) -> DataFrame:
    """Solutions of all patterns together, one column per variable.

    Terms that start with ``?`` are variables, all others are constants. The graph is a set of
    triples; solutions are a bag. A constant predicate becomes a filter that prunes partitions
    of a stored graph, or mapping steps of a virtual one. Patterns are joined connected ones
    first, rarest first when ``counts`` is given; one that is counted small is broadcast, so that a hub
    (a genre of millions of works) is neither shuffled nor held by a task. With ``entailed`` (the ontology of a graph
    that has its inferred types) type patterns that a domain already implies are left out.
    """
    if entailed is not None:
        patterns = _without_implied_types(patterns, entailed)
    resource_vars = {t for s, p, _ in patterns for t in (s, p) if _is_var(t)}
    uses = Counter(t for pattern in patterns for t in {x for x in pattern if _is_var(x)})
    out, held, bound = None, None, set()
    for pattern in _join_order(patterns, counts):
        part, names = _bindings(graph, pattern, resource_vars, uses)
        n = (counts or {}).get(pattern[1])
        if out is None:
            out, held, whole = part, n, n is not None
        else:
            shared = sorted(bound & names)
            if not shared:
                raise ValueError(f"pattern {pattern} shares no variable with the ones before it")
            out = _joined(out, held, part, n, shared, whole)
            held, whole = max((x for x in (held, n) if x is not None), default=None), False
        bound |= names
    variables = dict.fromkeys(t[1:] for pattern in patterns for t in pattern if _is_var(t))
    return out.select(*[(F.col(v)["o"] if f"?{v}" not in resource_vars and uses[f"?{v}"] > 1 else F.col(v)).alias(v)
                        for v in variables])


def _joined(out: DataFrame, held: int | None, part: DataFrame, n: int | None, shared: list[str], whole: bool) -> DataFrame:
    """The solutions so far, about ``held`` of them (``whole``: at most), with those of a pattern of ``n`` triples."""
    if whole and held <= FEW_TRIPLES:
        return part.join(F.broadcast(out), shared)
    if n is not None and n <= FEW_TRIPLES:
        return out.join(F.broadcast(part), shared)
    # A sort-merge join holds the right side's rows of a key, so the side that is counted larger streams.
    return part.join(out, shared) if None not in (held, n) and held < n else out.join(part, shared)


def _bindings(graph, pattern, resource_vars, uses):
    s, p, o = pattern
    if isinstance(graph, VirtualGraph):
        rows = graph.scan(None if _is_var(p) else p, o if p == RDF_TYPE and not _is_var(o) else None)
    else:
        rows = graph
    cols, same = {}, {}
    for name, term in (("s", s), ("p", p), ("o", o)):
        if not _is_var(term):
            rows = rows.filter(F.col(name) == term)
            continue
        if name == "o" and term in resource_vars:
            rows = rows.filter(F.col("o_kind") == "iri")
        value = F.col(name)
        if name == "o" and term not in resource_vars and uses[term] > 1:
            # Literals are equal only with their kind and datatype.
            value = F.struct("o", "o_kind", F.coalesce("o_datatype", F.lit("")).alias("dt"))
        if term in cols:
            same[term] = (cols[term], value)
        else:
            cols[term] = value
    for left, right in same.values():
        rows = rows.filter(left == right)
    return rows.select(*[c.alias(t[1:]) for t, c in cols.items()]), {t[1:] for t in cols}


def _join_order(patterns, counts):
    size = lambda t: (counts or {}).get(t[1], 0)
    left = sorted(patterns, key=size)
    order, bound = [], set()
    while left:
        connected = [t for t in left if bound & {x for x in t if _is_var(x)}] if bound else left
        nxt = (connected or left)[0]
        left.remove(nxt)
        order.append(nxt)
        bound |= {x for x in nxt if _is_var(x)}
    return order


def _without_implied_types(patterns, ontology):
    domain = {r["property"]: r["domain"] for r in ontology}
    implied = {(s, domain.get(p)) for s, p, _ in patterns}
    return [t for t in patterns if not (t[1] == RDF_TYPE and (t[0], t[2]) in implied)]


def _is_var(term: str) -> bool:
    return term.startswith("?")
