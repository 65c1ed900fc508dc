"""Lines that several documents share: kept in the document with the smallest id, dropped elsewhere.

Lines are exploded to 128-bit hashes of their normalised form, once per document. Documents per hash
are counted with partial aggregation, the hashes over the threshold are written with their keeper and
joined back (a written table on both sides, so that adaptive execution can split a line that a third
of all documents hold), and each document gets its own list of hashes to drop. Only that last join
moves texts; the lines that stay are put together again in the order of their positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegraph.llm.shared import LOWER, SPACES, UPPER, arrow_rows, stored, table, with_arrow

MIN_CHARS, MIN_DOCS = 10, 2
_STRIP = SPACES.decode()


def line_key(line: str, min_chars: int) -> bytes | None:
    """Hash of a line without outer white space and with A-Z lower-cased; None if it is too short to count."""
    line = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys = [], []
            for i, text in enumerate(batch.column(1)):
                own = {line_key(line, min_chars) for line in (text.as_py() or "").split("\n")} - {None}
                keys += own
                owners += [i] * len(own)
                if len(keys) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(keys, pa.binary())],
                                                     ["doc_id", "key"])
                    owners, keys = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(keys, pa.binary())],
                                             ["doc_id", "key"])
    return run


def _rest(min_chars: int):
    def run(drops: pa.Array, column: pa.Array) -> list[pa.Array]:
        texts, lines, dropped = [], [], []
        for drop, text in zip(drops, column):
            parts = (text.as_py() or "").split("\n")
            lines.append(len(parts))
            if drop.is_valid:
                drop = set(drop.as_py())
                parts = [p for p in parts if line_key(p, min_chars) not in drop]
            texts.append("\n".join(parts))
            dropped.append(lines[-1] - len(parts))
        return [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return run


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and ``n_lines``, ``n_dropped`` or other names.

    Other columns pass; columns named like an output are replaced by it. A null or empty text is one
    empty line. Rows that share a doc_id are one document: none of them loses a line for another. Rows
    with a null doc_id neither count nor lose lines. An empty table gives an empty table.
    """
    arrow_rows(docs.sparkSession)
    keys = stored(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
                  .mapInArrow(_keys(min_chars), "doc_id long, key binary"), "line-keys")
    shared = stored(keys.distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
                    .filter(F.col("n") >= min_docs).select("key", "keeper"), "shared-lines")
    drops = stored(keys.join(shared, "key").filter("doc_id <> keeper")
                   .groupBy(F.col("doc_id").alias("_owner")).agg(F.collect_set("key").alias("_drop")), "drops")
    joined = docs.join(drops.hint("shuffle_hash"), docs["doc_id"].cast("long") == drops["_owner"], "left").drop("_owner")
    outputs = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in counts]]
    return with_arrow(joined, ["_drop", "text"], outputs, _rest(min_chars)).drop("_drop")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the lines that an earlier document holds; a null text is one empty line."""
    kept = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (
  SELECT k.*, coalesce(s.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, row_id
"""
