"""Rows to triples, declared as a mapping and evaluated column-wise in one pass without Python.

A triple is ``(s, p, o, o_kind, o_datatype)``; ``o_kind`` is ``iri`` or ``literal`` and
``o_datatype`` is set for literals only. Triples with a missing subject or object are not made.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces.
BASE = "http://example.org/moviekg/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"

COLUMNS = ("s", "p", "o", "o_kind", "o_datatype")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
ITEM = "$item"

# Characters an IRI must not contain, and "%", so that encoding stays one-to-one.
_NOT_IRI = r'[\x00-\x20<>"{}|^`\\%]'


@dataclass(frozen=True)
class Node:
    """An IRI ``<base><cls>/<key>``; several key columns are joined by ``_``.

    A key is a column name, ``ITEM`` for the element of the enclosing list, or a ``Column``.
    """

    cls: str
    key: tuple

    def __init__(self, cls: str, *key):
        object.__setattr__(self, "cls", cls)
        object.__setattr__(self, "key", key)


@dataclass(frozen=True)
class Type:
    node: Node
    when: Column | None = None


@dataclass(frozen=True)
class Attr:
    """A literal: ``value`` is a column name, ``ITEM`` or a ``Column``."""

    node: Node
    prop: str
    value: object
    datatype: str = "string"
    when: Column | None = None


@dataclass(frozen=True)
class Link:
    """``position`` limits a link inside a list to the ``first`` element or to the ``rest``."""

    node: Node
    prop: str
    target: Node
    position: str | None = None
    when: Column | None = None


@dataclass(frozen=True)
class ForEach:
    """Steps for every non-empty element of a list column."""

    array: str
    steps: tuple
    when: Column | None = None


@dataclass(frozen=True)
class Mapping:
    """Steps for every row whose ``when`` is true."""

    steps: tuple
    when: Column | None = None
    base: str = BASE


def encode_iri_part(col: Column) -> Column:
    """Percent-encode what an IRI cannot hold; clean text passes after one test."""
    one = lambda ch: F.when(ch.rlike(_NOT_IRI), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return F.when(col.rlike(_NOT_IRI), F.array_join(F.transform(F.split(col, ""), one), "")).otherwise(col)


def only(mapping: Mapping, predicates, cls: str | None = None) -> Mapping:
    """The part of a mapping that can produce ``predicates`` (full IRIs), types only of ``cls`` if given.

    What is left out is never computed, so Catalyst prunes its columns down to the scan.
    """
    wanted = set(predicates)

    def makes(s):
        if isinstance(s, Type):
            return RDF_TYPE in wanted and cls in (None, mapping.base + s.node.cls)
        return mapping.base + s.prop in wanted

    def keep(steps):
        out = []
        for s in steps:
            if isinstance(s, ForEach):
                inner = keep(s.steps)
                if inner:
                    out.append(replace(s, steps=tuple(inner)))
            elif makes(s):
                out.append(s)
        return out

    return replace(mapping, steps=tuple(keep(mapping.steps)))


def rows_to_triples(df: DataFrame, mapping: Mapping) -> DataFrame:
    """All triples of all rows; duplicates stay (``merge_triples`` gives the set).

    Each row is first opened into one row of its own plus one per list element. Then every key
    is encoded once, every IRI is put together once, and the triples of that row are lined up
    from those columns: one pass, no shuffle, compiled code throughout.
    """
    if not mapping.steps:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return _evaluate(df, mapping, lambda step, iri: _fields(step, mapping.base, iri))


def _evaluate(df: DataFrame, mapping: Mapping, fields) -> DataFrame:
    """A row of ``fields(step, columns of its nodes)`` for every triple, ``s`` and ``o`` among them."""
    df, groups = _opened(df, mapping)
    lists = PART in df.columns
    keys, nodes = _Names("_key"), _Names("_iri")
    for part, steps in groups:
        for step in steps:
            for node in _nodes(step):
                nodes.add((part, _identity(node)), (node, [keys.add(_identity(k), k) for k in node.key]))
    df = _encoded(df, dict(keys.items()))
    iris = {}
    for (part, _), (name, (node, parts)) in nodes.entries():
        iri = F.concat(F.lit(_prefix(node, mapping.base)), *_between(parts))
        iris[name] = F.when(F.col(PART) == part, iri) if lists else iri
    df = df.withColumns(iris)

    def made(part, step):
        return fields(step, lambda node: F.col(nodes.name((part, _identity(node)))))

    if len(groups) == 1 and len(groups[0][1]) == 1:
        # No generator needed, so filters and pruning go straight through to the scan.
        part, step = groups[0][0], groups[0][1][0]
        needed = [F.col(k) for node in _nodes(step) for k in node.key if isinstance(k, str)]
        needed += [_value(step.value)] if isinstance(step, Attr) else []
        out = df.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in needed], F.lit(True)))
        out = out.select(*made(part, step))
    else:
        triples = None
        for part, steps in groups:
            rows = F.array(*[F.struct(*made(part, s)) for s in steps])
            here = F.col(PART) == part if lists else F.lit(True)
            triples = F.when(here, rows) if triples is None else triples.when(here, rows)
        out = df.select(F.inline(triples))
    return out.filter("s IS NOT NULL AND o IS NOT NULL")


def rejected_triples(df: DataFrame, mapping: Mapping) -> DataFrame:
    """(p, rejected): triples that the mapping would make and leaves out, because a key or value is null.

    One pass with partial sums. A step whose ``when`` is not true asks for no triple, and neither does
    an empty list element, so they reject none. Every property has a row, also with 0.
    """
    if mapping.when is not None:
        df = df.filter(mapping.when)
    counted: dict[str, list[Column]] = {}

    def count(step, times: Column) -> None:
        needed = [k for node in _nodes(step) for k in node.key] + ([step.value] if isinstance(step, Attr) else [])
        lacking = reduce(lambda a, b: a | b, [_value(k).isNull() for k in needed if not _is_item(k)], F.lit(False))
        asked = lacking if step.when is None else lacking & F.coalesce(step.when, F.lit(False))
        prop = RDF_TYPE if isinstance(step, Type) else mapping.base + step.prop
        counted.setdefault(prop, []).append(F.when(asked, times).otherwise(0))

    for step in mapping.steps:
        if not isinstance(step, ForEach):
            count(step, F.lit(1))
            continue
        items = F.filter(F.col(step.array), lambda x: x.isNotNull() & (x.cast("string") != ""))
        if step.when is not None:
            items = F.when(step.when, items)
        size = F.coalesce(F.size(items), F.lit(0))
        size = F.greatest(size, F.lit(0))
        for inner in step.steps:
            position = getattr(inner, "position", None)
            some = {"first": F.least(size, F.lit(1)), "rest": F.greatest(size - 1, F.lit(0))}.get(position, size)
            count(inner, some)
    sums = {p: F.coalesce(F.sum(reduce(lambda a, b: a + b, parts)), F.lit(0)).cast("bigint") for p, parts in counted.items()}
    row = df.agg(*[c.alias(f"_r{i}") for i, c in enumerate(sums.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_r{i}").alias("rejected")) for i, p in enumerate(sums)])))


def _is_item(key) -> bool:
    return isinstance(key, str) and key == ITEM


def union_triples(*frames: DataFrame) -> DataFrame:
    """All triples of all frames, repeats included."""
    return reduce(lambda a, b: a.unionByName(b), frames).select(*COLUMNS)


def merge_triples(*frames: DataFrame) -> DataFrame:
    """Set union. Repeated triples are dropped on the map side before the shuffle."""
    return union_triples(*frames).distinct()


def set_of_triples(*sources: tuple[DataFrame, Mapping], ontology: list[dict] | None = None) -> DataFrame:
    """The set of triples of tables with their mappings, and with the types that follow from an ontology.

    Repeats are dropped before there are any triples. What a row says is cut into facts: a fact is the values that
    some of its triples are made of, and a mask with a bit for each of these triples. A rating's type and both
    its links are one fact of a user and a movie, and so are types that the ontology implies. Facts with the
    same values become one, masks joined; the triples of what is left are all different and are put together
    without another shuffle. Where a composite key could be read in two ways, or triples of one kind are made
    of different values, the ends of the triple are the fact; where only IRIs could tell triples apart, the
    triples themselves are made distinct.
    """
    sources = [(df, mapping) for df, mapping in sources if mapping.steps] or sources
    spark = sources[0][0].sparkSession
    if not sources[0][1].steps:
        return spark.createDataFrame([], SCHEMA)
    opened = [_opened(df, mapping) for df, mapping in sources]
    plan = _Plan(ontology or [])
    for (_, mapping), (df, groups) in zip(sources, opened):
        plan.add(df, groups, mapping.base)
    if _confusable(list(plan.codes)) or not plan.plain_keys:
        from .entail import rdfs_entail
        every = union_triples(*[rows_to_triples(df, mapping) for df, mapping in sources])
        return rdfs_entail(every, ontology) if ontology else every.distinct()

    plan.settle()
    # Four kinds, so that the compiled code of each stays small.
    found = []
    for kind in (_SIMPLE, _PAIRED, _COMPOSITE, _ALONE):
        frames = [f for i, (df, groups) in enumerate(opened) for f in plan.facts(i, df, groups, kind)]
        if frames:
            facts = reduce(lambda a, b: a.union(b), frames)
            # Pairs of values seldom repeat within a task: those facts are dealt first, single values combine before.
            facts = facts.repartition(*plan.columns) if kind in (_PAIRED, _COMPOSITE) else facts
            found.append(plan.triples(facts.groupBy(*plan.columns).agg(F.bit_or("mask").alias("mask")), kind))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    part = lambda i: F.array(*[F.lit(key[i]).cast("string") for key in plan.codes])[F.col("code")]
    return reduce(lambda a, b: a.union(b), found).select(
        F.concat(part(0), "s").alias("s"), part(1).alias("p"), F.concat(part(3), "o").alias("o"),
        part(2).alias("o_kind"), part(4).alias("o_datatype"))


def to_ntriples(triples: DataFrame, name: str = "line") -> DataFrame:
    """One N-Triples line per triple."""
    text = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    literal = F.concat(F.lit('"'), text, F.lit('"^^<'), F.col("o_datatype"), F.lit(">"))
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(literal)
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), obj, F.lit(" ."))
                          .alias(name))


@dataclass(frozen=True)
class Source:
    """A table with its mapping. ``unique``: properties whose triples its rows never repeat
    (``RDF_TYPE`` for the type triples)."""

    table: DataFrame
    mapping: Mapping
    unique: tuple[str, ...] = ()


class VirtualGraph:
    """A graph that is not stored: tables with their mappings, evaluated per predicate.

    A scan for one predicate runs only the mapping steps that make it, so a graph query reads
    just the tables and columns its predicates come from. A predicate that one source makes
    without repeats needs no ``distinct``, hence no shuffle of its own.
    """

    def __init__(self, *sources: Source):
        self.sources = sources

    def scan(self, predicate: str | None = None, cls: str | None = None) -> DataFrame:
        """The set of triples of one predicate (and class, for type triples), or of all.

        Repeats among all triples are dropped by facts, whose keys are shorter than IRIs.
        """
        if predicate is None:
            return set_of_triples(*[(source.table, source.mapping) for source in self.sources])
        parts, unique = [], False
        for source in self.sources:
            m = only(source.mapping, [predicate], cls)
            if m.steps:
                parts.append(rows_to_triples(source.table, m))
                unique = predicate in {p if p == RDF_TYPE else m.base + p for p in source.unique}
        if not parts:
            return self.sources[0].table.sparkSession.createDataFrame([], SCHEMA)
        return parts[0] if len(parts) == 1 and unique else merge_triples(*parts)


PART, INDEX = "_part", "_index"


class _Names:
    """Column names for keyed expressions, each key once."""

    def __init__(self, prefix: str):
        self._prefix, self._entries = prefix, {}

    def add(self, key, value) -> str:
        return self._entries.setdefault(key, (f"{self._prefix}{len(self._entries)}", value))[0]

    def name(self, key) -> str:
        return self._entries[key][0]

    def items(self):
        return self._entries.values()

    def entries(self):
        return self._entries.items()


def _opened(df: DataFrame, mapping: Mapping) -> tuple[DataFrame, list[tuple[int, tuple]]]:
    """The rows a mapping wants, lists opened, and the steps by part."""
    if mapping.when is not None:
        df = df.filter(mapping.when)
    plain = tuple(s for s in mapping.steps if not isinstance(s, ForEach))
    lists = [s for s in mapping.steps if isinstance(s, ForEach)]
    if lists:
        df = df.select("*", F.inline(_open_lists(plain, lists)))
    return df, ([(0, plain)] if plain else []) + [(i, each.steps) for i, each in enumerate(lists, 1)]


def _open_lists(plain, lists) -> Column:
    """``(_part, _index, $item)``: part 0 for the row itself, part i for the elements of list i."""
    def opened(i, each):
        items = F.filter(F.col(each.array), lambda x: x.isNotNull() & (x.cast("string") != ""))
        if each.when is not None:
            items = F.when(each.when, items)
        rows = F.transform(items, lambda x, index: _tag(i, index, x.cast("string")))
        return F.coalesce(rows, F.array().cast(_TAGS))

    parts = [opened(i, each) for i, each in enumerate(lists, 1)]
    if plain:
        parts.insert(0, F.array(_tag(0, F.lit(0), F.lit(None).cast("string"))))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _tag(part: int, index: Column, item: Column) -> Column:
    return F.struct(F.lit(part).alias(PART), index.alias(INDEX), item.alias(ITEM))


def _nodes(step) -> list[Node]:
    return [step.node, step.target] if isinstance(step, Link) else [step.node]


def _fields(step, base: str, iri) -> list[Column]:
    s = iri(step.node)
    if isinstance(step, Type):
        fields = (s, F.lit(RDF_TYPE), F.lit(base + step.node.cls), F.lit("iri"), F.lit(None))
    elif isinstance(step, Attr):
        fields = (s, F.lit(base + step.prop), _value(step.value).cast("string"), F.lit("literal"),
                  F.lit(XSD + step.datatype))
    else:
        if step.position:
            s = F.when(F.col(INDEX) == 0 if step.position == "first" else F.col(INDEX) > 0, s)
        fields = (s, F.lit(base + step.prop), iri(step.target), F.lit("iri"), F.lit(None))
    if step.when is not None:
        fields = (F.when(step.when, fields[0]), *fields[1:])
    return [f.cast("string").alias(c) for f, c in zip(fields, COLUMNS)]


def _prefix(node: Node, base: str) -> str:
    return f"{base}{node.cls}/"


def _confusable(codes: list[tuple]) -> bool:
    """Whether two numbers can stand for one triple: what they share ends in the midst of the other's."""
    nested = lambda a, b: a.startswith(b) or b.startswith(a)
    for i, (s, p, kind, o, datatype) in enumerate(codes):
        for t, q, other, x, d in codes[:i]:
            if (p, kind, datatype) == (q, other, d) and nested(s, t) and (o == x if p == RDF_TYPE else nested(o, x)):
                return True
    return False


class _Plan:
    """Which triples of which sources are made of the same values, and so are bits of one fact.

    A code stands for all that is the same in the triples of a step. Its form says where in the fact the keys of both ends
    are; ``cut`` are the places whose text must be free of the separator, because a composite key holds them.
    """

    def __init__(self, ontology: list[dict]):
        self.ontology, self.codes, self.plain_keys = ontology, {}, True
        self.made: list[list[tuple]] = []  # per source: part, code, values, form, further values that must be there, condition
        self.texts: list[dict] = []  # per source: the names of its values
        self.forms: dict[int, set] = {}

    def _types(self, prop: str, end: str) -> list[str]:
        return list(dict.fromkeys(r[end] for r in self.ontology if r["property"] == prop and r[end] and not (end == "range" and r["range_is_literal"])))

    def add(self, df: DataFrame, groups, base: str) -> None:
        made, texts = [], {}
        number = lambda *key: self.codes.setdefault(key, len(self.codes))

        def name(key) -> str:
            return texts.setdefault(_identity(key), (f"_v{len(texts)}", key))[0]

        def put(part, code, s, o, needed, when) -> None:
            values = tuple(sorted(set(s) | set(o or ()), key=lambda n: int(n[2:])))
            at = lambda names: None if names is None else tuple(values.index(n) for n in names)
            cut = tuple(sorted({values.index(n) for names in (s, o or ()) if len(names) > 1 for n in names}))
            form = (len(values), at(s), at(o), cut)
            self.forms.setdefault(code, set()).add(form)
            made.append((part, code, values, form, tuple(n for n in needed if n not in values), when))

        for part, steps in groups:
            for step in steps:
                prefix, s, when = _prefix(step.node, base), tuple(map(name, step.node.key)), step.when
                if isinstance(step, Type):
                    key, o = (prefix, RDF_TYPE, "iri", base + step.node.cls, None), None
                elif isinstance(step, Attr):
                    key, o = (prefix, base + step.prop, "literal", "", XSD + step.datatype), (name(step.value),)
                else:
                    key, o = (prefix, base + step.prop, "iri", _prefix(step.target, base), None), tuple(map(name, step.target.key))
                    if step.position:
                        here = F.col(INDEX) == 0 if step.position == "first" else F.col(INDEX) > 0
                        when = here if when is None else here & when
                put(part, number(*key), s, o, (), when)
                for c in self._types(key[1], "domain"):
                    put(part, number(prefix, RDF_TYPE, "iri", c, None), s, None, o or (), when)
                for c in self._types(key[1], "range") if key[2] == "iri" else ():
                    # What a type triple points at is a class, whose IRI is no key.
                    put(part, number(key[3], RDF_TYPE, "iri", c, None), o if o else (name(F.lit("")),), None, s, when)
        nodes = {_identity(k) for _, steps in groups for step in steps for node in _nodes(step) for k in node.key}
        kinds = df.select(*[_value(k).alias(n) for i, (n, k) in texts.items() if i in nodes]).schema.fields
        self.plain_keys &= all(isinstance(f.dataType, _KEY_TYPES) for f in kinds)
        self.made.append(made)
        self.texts.append(texts)

    def settle(self) -> None:
        """Gives each code a fact and a bit: codes that some source makes of the same values share a fact."""
        alone = {code for code, forms in self.forms.items() if len(forms) > 1}
        group = {code: code for code in self.forms}
        for made in self.made:
            together: dict[tuple, int] = {}
            for part, code, values, form, _, _ in made:
                if code not in alone:
                    other = group[together.setdefault((part, values, form[3]), code)]
                    group = {c: other if g == group[code] else g for c, g in group.items()}
        self.place, sizes, self.of = {}, {}, {}
        for code in self.forms:
            if code not in alone:
                i = sizes[group[code]] = sizes.get(group[code], -1) + 1
                fact = self.of.setdefault((group[code], i // _BITS), len(self.of))
                self.place[code] = (fact, i % _BITS)
        self.width = max(2, *[form[0] for forms in self.forms.values() for form in forms])
        self.columns = ["f", *[f"k{i}" for i in range(self.width)]]
        self.single = {code: len(self.of) + i for i, code in enumerate(self.forms)}

    def facts(self, source: int, df: DataFrame, groups, kind: str) -> list[DataFrame]:
        """The facts of a source as ``columns`` and ``mask``: of one value, of several, of composite keys, or triples on their own."""
        rows: dict[int, dict] = {}
        for part, code, values, form, needed, when in self.made[source]:
            asked = [F.col(n).isNotNull() for n in needed] + ([] if when is None else [F.coalesce(when, F.lit(False))])
            said = reduce(lambda a, b: a & b, asked, F.lit(True))
            if code in self.place and kind == _kind(form):
                fact, bit = self.place[code]
                bits = rows.setdefault(part, {}).setdefault((fact, values, form[3], None), {})
                bits[bit] = bits[bit] | said if bit in bits else said
            if kind == _ALONE and (form[3] or code not in self.place):
                bits = rows.setdefault(part, {}).setdefault((self.single[code], values, form[3] if code in self.place else None, form), {})
                bits[0] = bits[0] | said if 0 in bits else said
        if not rows:
            return []
        texts = {n: _value(k).cast("string").alias(n) for n, k in self.texts[source].values()}
        used = {n for facts in rows.values() for _, values, _, _ in facts for n in values}
        used |= {n for _, _, _, _, needed, _ in self.made[source] for n in needed}
        df = df.withColumns({n: c for n, c in texts.items() if n in used})
        if kind == _ALONE and all(cut for facts in rows.values() for _, _, cut, _ in facts):
            split = {values[i] for facts in rows.values() for _, values, cut, _ in facts for i in cut}
            df = df.filter(reduce(lambda a, b: a | b, [F.contains(n, F.lit("_")) for n in sorted(split)]))
        listed = None
        for part, facts in rows.items():
            entries = F.array(*[self._entry(fact, values, cut, form, bits) for (fact, values, cut, form), bits in facts.items()])
            here = F.col(PART) == part if PART in df.columns else F.lit(True)
            listed = F.when(here, entries) if listed is None else listed.when(here, entries)
        return [df.select(F.inline(listed)).filter("f IS NOT NULL AND mask <> 0")]

    def _entry(self, fact: int, values, cut, form, bits) -> Column:
        """A row of a fact; with ``form`` the ends of one triple, of values that a composite key would not tell apart."""
        whole = [F.col(n).isNotNull() for n in values]
        split = [F.contains(n, F.lit("_")) for n in (values[i] for i in cut or ())]
        if form is None:
            keys = [F.col(n) for n in values]
            whole += [~x for x in split]
        else:
            end = lambda at: F.concat(*_between([encode_iri_part(F.col(values[i])) for i in at]))
            literal = form[2] is not None and list(self.codes)[fact - len(self.of)][2] == "literal"
            keys = [end(form[1]), F.lit("") if form[2] is None else F.col(values[form[2][0]]) if literal else end(form[2])]
            whole += [reduce(lambda a, b: a | b, split)] if cut else []
        keys += [F.lit(None).cast("string")] * (self.width - len(keys))
        mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(said, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for bit, said in bits.items()])
        row = F.struct(F.lit(fact).alias("f"), *[k.alias(c) for k, c in zip(keys, self.columns[1:])], mask.alias("mask"))
        return F.when(reduce(lambda a, b: a & b, whole, F.lit(True)), row)

    def triples(self, facts: DataFrame, kind: str) -> DataFrame:
        """``code, s, o``: the triples of different facts of a kind."""
        if kind == _ALONE:
            code = F.element_at(F.array(*[F.lit(c) for c in self.single]), F.col("f") - len(self.of) + 1)
            return facts.select(code.alias("code"), F.col("k0").alias("s"), F.col("k1").alias("o"))
        literal = [key[2] == "literal" for key in self.codes]
        place = {code: at for code, at in self.place.items() for form in self.forms[code] if kind == _kind(form)}
        ends = {i for code in place for form in self.forms[code] for i in (*form[1], *(() if literal[code] else form[2] or ()))}
        facts = facts.withColumns({f"e{i}": encode_iri_part(F.col(f"k{i}")) for i in sorted(ends)})
        triple = lambda code, s, o: F.struct(F.lit(code).alias("code"), s.alias("s"), o.alias("o"))
        of: dict[int, list[Column]] = {}
        for code, (fact, bit) in place.items():
            (form,) = self.forms[code]
            end = lambda at: F.concat(*_between([F.col(f"e{i}") for i in at]))
            o = F.lit("") if form[2] is None else F.col(f"k{form[2][0]}") if literal[code] else end(form[2])
            of.setdefault(fact, []).append(F.when(F.col("mask").bitwiseAND(1 << bit) != 0, triple(code, end(form[1]), o)))
        rows = reduce(lambda w, item: w.when(F.col("f") == item[0], F.array(*item[1])), of.items(), F.when(F.lit(False), None))
        return facts.select(F.inline(rows)).filter("code IS NOT NULL")


def _kind(form: tuple) -> str:
    return _COMPOSITE if form[3] else _PAIRED if form[0] > 1 else _SIMPLE


def _between(parts: list) -> list[Column]:
    out: list[Column] = []
    for part in parts:
        if out:
            out.append(F.lit("_"))
        out.append(F.col(part) if isinstance(part, str) else part)
    return out


def _encoded(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """The key columns as text fit for an IRI; numbers, dates and flags need no encoding."""
    raw = df.select(*[_value(k).alias(name) for name, k in keys.items()]).schema
    text = {f.name for f in raw.fields if isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType))}
    parts = {name: _value(k).cast("string") for name, k in keys.items()}
    return df.withColumns({name: encode_iri_part(c) if name in text else c for name, c in parts.items()})


def _identity(key):
    """What is built once for equal keys and nodes: names by value, expressions by object."""
    if isinstance(key, Node):
        return key.cls, tuple(_identity(k) for k in key.key)
    return key if isinstance(key, str) else id(key)


def _value(key) -> Column:
    return key if isinstance(key, Column) else F.col(f"`{key}`")


# Key columns whose text only changes by encoding if it is a text.
_KEY_TYPES = (T.StringType, T.TimestampType, T.TimestampNTZType, T.NumericType, T.BooleanType, T.DateType, T.NullType)
_BITS = 60
_SIMPLE, _PAIRED, _COMPOSITE, _ALONE = "simple", "paired", "composite", "alone"

_TAGS = T.ArrayType(T.StructType([
    T.StructField(PART, T.IntegerType()), T.StructField(INDEX, T.IntegerType()), T.StructField(ITEM, T.StringType())]))
