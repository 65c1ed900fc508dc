"""Benchmark items inside documents: size-partitioned MinHash containment search, exact verification.

Items are partitioned by the size of their shingle set (powers of two). An item of a partition with at
most u shingles is represented by its smallest u - ceil(u * t) + 1 hashes, a bottom-k MinHash sketch.
A document that contains a share t of the item misses fewer shingles than that, so it holds at least
one of the sketch: no item is lost, whatever the length of the document. The documents' shingles are
hashed as they are exploded, inside generated code, and meet the sketches in a hash join; documents too
short for an item are left out there. Each candidate pair is then verified on the shingles as text.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.op8_minhash_dedup import without_ids
from lakegraph.llm.shared import LOWER, SHINGLE_WORDS, SPACES, UPPER, stored, table

PERCENT = 75
# Rows of sketches, or of candidate documents' ids, up to which they are broadcast; more are shuffled.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Array of the words of a text; null for a text without words."""
    text = F.btrim(F.translate(text, UPPER, LOWER), F.lit(SPACES.decode()))
    return F.when(F.length(text) > 0, F.split(text, r"[\x20\x09-\x0D]+"))


def _starts(words: Column, k: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def _shingles(words: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame, percent: int, k: int) -> DataFrame:
    """``h, item_id, need``: the smallest hashes of each item, as many as its size partition asks for."""
    hashes = F.array_sort(F.array_distinct(F.transform(_starts(F.col("w"), k), lambda i: _hash(F.col("w"), i, k))))
    items = items.select("item_id", F.col("w"), hashes.alias("h")).withColumn("n", F.size("h"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    taken = (upper - F.ceil(upper * percent / 100) + 1).cast("int")
    need = F.ceil(F.col("n") * percent / 100)
    return items.select("item_id", need.alias("need"), F.explode(F.slice("h", F.lit(1), taken)).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: each pair where at least ``percent`` of the item's shingles are there.

    Shingles are sets of k words; a text with fewer words is one shingle of all of them, so a short item
    is found only in a document that consists of it. Null, empty and blank texts hold and match nothing.
    Rows with a null doc_id or item_id are left out. Rows that share an id are compared one by one; the
    pair gets the largest n_shared, with its n_item. Other columns are ignored.
    """
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), words(F.col("text")).alias("w")).filter("w is not null")
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), words(F.col("text")).alias("w")).filter("w is not null")
    items = stored(items, "items")
    wanted = stored(sketches(items, percent, k), "item-sketches")
    hashed = docs.select("doc_id", "w", F.explode(_starts(F.col("w"), k)).alias("i")).select(
        "doc_id", F.size("w").alias("length"), _hash(F.col("w"), F.col("i"), k).alias("h"))
    candidates = stored(hashed.join(_bounded(wanted), "h").filter(F.greatest(F.col("length") - (k - 1), F.lit(1)) >= F.col("need"))
                        .select(F.col("doc_id").alias("found"), "item_id").distinct(), "candidates")
    pairs = docs.join(_bounded(candidates), F.col("doc_id") == F.col("found")).select("doc_id", "item_id", _shingles(F.col("w"), k).alias("have"))
    pairs = pairs.join(_bounded(items.select("item_id", _shingles(F.col("w"), k).alias("want"))), "item_id")
    shared = F.size(F.array_intersect("have", "want")).cast("long")
    best = F.max(F.struct(shared.alias("n_shared"), F.size("want").cast("long").alias("n_item")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.n_shared", "b.n_item").filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs``, all columns, without the documents that contain an item; rows with a null doc_id stay."""
    return without_ids(docs, contained_items(docs, items, percent, k).select("doc_id"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they contain; null and empty texts contain none."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sets_sql(source: str, key: str) -> str:
    k = SHINGLE_WORDS
    return f"""
  SELECT DISTINCT {key}, row_id, array_to_string(w[i:i + {k - 1}], ' ') AS shingle
  FROM (SELECT {key}, row_id, w, unnest(range(1, greatest(len(w) - {k}, 0) + 2)) AS i
        FROM (SELECT {key}, row_number() OVER () AS row_id,
                     regexp_split_to_array(trim(translate(text, '{UPPER}', '{LOWER}'), {_SPACE_SQL}), '[\\x20\\x09-\\x0D]+') AS w
              FROM {source}
              WHERE {key} IS NOT NULL AND trim(text, {_SPACE_SQL}) <> ''))"""


SQL = f"""
WITH have AS ({_sets_sql("documents", "doc_id")}),
want AS ({_sets_sql("benchmark", "item_id")}),
sizes AS (SELECT row_id, count(*) AS n_item FROM want GROUP BY row_id),
pairs AS (
  SELECT h.doc_id, w.item_id, h.row_id, w.row_id AS item_row, count(*) AS n_shared
  FROM have h JOIN want w ON h.shingle = w.shingle GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item
FROM pairs JOIN sizes ON sizes.row_id = item_row
WHERE n_shared * 100 >= n_item * {PERCENT}
"""
