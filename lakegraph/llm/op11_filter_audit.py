"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document is reduced to the set of filters that it fails, and documents are counted by part and failure
set, so what follows does not grow with the corpus. The states of the audit are the subsets of filters
applied so far; an edge adds one filter. A forward pass counts the orders that reach a state, a
backward pass those that leave it for the end; their product is the number of orders through an edge.
What an edge removes (documents that fail its filter and none before) is computed once: weighted by
the orders through it, it sums to the filter's Shapley numerator, and each order reads its steps from
the same edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import PIECE, UPPER, stored, table, with_arrow

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
# All orders of so many filters are listed at most: 40,320 orders of 8 steps for each part.
MOST_FILTERS = 8
STATISTICS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---- what a document fails

def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces that end before white space."""
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE)
        end = space.start() if space else len(raw)
        yield raw[at:end]
        at = end


def _counts(raw: bytes) -> tuple[int, ...]:
    """STATISTICS of a text in UTF-8."""
    words, seen, rest = 0, set(), [0, 0, 0]
    for piece in _pieces(raw):
        own = piece.split()
        words += len(own)
        seen.update(own)
        for i, drop in enumerate((UPPER.encode(), bytes(range(0x80, 0xC0)), SYMBOLS.encode())):
            rest[i] += len(piece) - len(piece.translate(None, drop))
    return words, len(seen), rest[0], len(raw) - rest[1], rest[2]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with counts over whole texts: words, distinct words, A-Z, code points, and any of ``SYMBOLS``.

    Words are maximal runs without ``[\\x20\\x09-\\x0D]``, case counts. A null text counts as empty. Columns named as in
    ``STATISTICS`` are replaced.
    """
    def run(column: pa.Array) -> list[pa.Array]:
        rows = [_counts((value.as_py() or "").encode()) for value in column]
        return [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(STATISTICS)
    return with_arrow(df, [text], [T.StructField(n, T.LongType()) for n in STATISTICS], run)


def text_failures() -> dict[str, Column]:
    """The conditions on one text, over the columns of ``statistics``."""
    return {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def with_later_copies(df: DataFrame, name: str, key: str, id_: str = "doc_id") -> DataFrame:
    """``df``, a written table, with a flag: another row of the same key has a smaller id.

    Rows with a null id come before nothing and after nothing. The smallest ids combine before their
    shuffle and are joined by key and id, so a key that a third of the rows hold is dealt over all tasks.
    """
    first = df.filter(F.col(id_).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(id_).alias("_first"))
    found = df.join(first, (df[key] == first["_key"]) & (df[id_] == first["_first"]), "left")
    return found.withColumn(name, F.col(id_).isNotNull() & F.col("_first").isNull()).drop("_key", "_first")


# ---- the lattice

def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Orders that reach each subset of k filters from the empty one, and that lead from it to the full one."""
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def failure_counts(df: DataFrame, failures: list[Column], part: Column, losses: dict[str, Column]) -> DataFrame:
    """``part, mask, n`` and one count per loss: documents by part and set of failed filters (bit i: filter i)."""
    if len(failures) > MOST_FILTERS:
        raise ValueError(f"{len(failures)} filters are more than {MOST_FILTERS}")
    mask = sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(failures)), F.lit(0))
    flags = {name: F.coalesce(c, F.lit(False)) for name, c in losses.items()}
    flat = df.select(part.alias("part"), mask.alias("mask"), *[c.cast("long").alias(f"_l{i}") for i, c in enumerate(flags.values())])
    return flat.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(len(flags))])


def audit(df: DataFrame, failures: dict[str, Column], part: Column | None = None, losses: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters (their names joined) and step (from 1, applied left to right).

    ``filter`` is the step's; ``kept`` documents are left after it, ``removed`` go here, ``redundant`` fail it but
    were removed before, ``unique_fails`` fail it only, ``<name>_lost`` are removed here and have that flag;
    ``shapley`` sums what the filter removes over all orders. Zeros are included. A condition or flag
    that is null counts as false, a part that is null as ``''``. An empty table has no parts and gives no rows.
    """
    losses = losses or {}
    part = F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit(""))
    names, k = list(failures), len(failures)
    counts = failure_counts(df, list(failures.values()), part, losses)
    reach, leave = path_counts(k)
    edges = [(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("weight"))
                               for s, f, w in edges])).alias("e")
    met = counts.select("*", edge).select("*", "e.*")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    goes = fails & ~before
    some = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    sums = met.groupBy("part", "state", "f", "bit", "weight").agg(
        some(~fails & ~before).alias("kept"), some(goes).alias("removed"), some(fails & before).alias("redundant"),
        some(F.col("mask") == F.col("bit")).alias("unique_fails"), *[some(goes, f"_l{i}").alias(f"{name}_lost") for i, name in enumerate(losses)])
    orders_through = Window.partitionBy("part", "f")
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(orders_through))
    steps = [("".join(names[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i])
             for order in permutations(range(k)) for i in range(k)]
    listed = df.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, f int")
    letter = F.array(*map(F.lit, names))[F.col("f")]
    return sums.join(F.broadcast(listed), ["state", "f"]).select(
        "part", "filter_order", "step", letter.alias("filter"), "kept", "removed", "redundant", "unique_fails",
        *[f"{name}_lost" for name in losses], "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters on every whole text of documents, audited by language, with the good and toxic labels they lose.

    A document whose label rows differ has a flag if one of them does. See ``audit`` for the columns.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    whole = F.coalesce(F.col("text"), F.lit(""))
    read = statistics(docs.withColumn("text_key", F.sha2(whole, 256))).select("doc_id", "lang", "text_key", *STATISTICS)
    facts = with_later_copies(stored(read, "facts"), "_copy", "text_key")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    judged = facts.join(labels, facts["doc_id"] == labels["_id"], "left")
    return audit(judged, text_failures() | {"E": F.col("_copy")}, F.col("lang"), {"good": F.col("_good"), "toxic": F.col("_toxic")})


SQL = f"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
failed AS (SELECT doc_id, part, [
    len(words) < {MIN_WORDS},
    100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {CAPITAL_PERCENT} * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM words),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
          FROM failed LEFT JOIN flags USING (doc_id) GROUP BY part, fails),
letter(c, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
           FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o, s::INTEGER AS step, o[s] AS f FROM orders, range(1, 6) r(s)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own,
               len([x FOR x IN o[1:step - 1] IF fails[x]]) > 0 AS before,
               len([x FOR x IN fails IF x]) = 1 AS single
        FROM masks, steps),
rows AS (SELECT part, filter_order, step, f, chr((64 + f)::INTEGER) AS filter,
    coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT before), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM rows
"""
