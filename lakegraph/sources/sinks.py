"""Writers. Tables go straight to their target; triples to files or to a caller's endpoint."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import to_ntriples

_OPEN_FILES = 32
_ROW_GROUP, _PAGE = 4 << 20, 256 << 10


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Store a graph by predicate, so that a pattern with a constant predicate reads one folder.

    A task has a file open for each predicate it meets, so triples are neither shuffled nor sorted to be written. Above
    ``_OPEN_FILES`` predicates Spark sorts the rest by name. Small row groups and pages bound what open files hold.
    """
    conf, key = triples.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(_OPEN_FILES))
    try:
        small = {"parquet.block.size": str(_ROW_GROUP), "parquet.page.size": str(_PAGE), "parquet.dictionary.page.size": str(_PAGE)}
        triples.write.mode("overwrite").options(**small).partitionBy("p").parquet(path)
    finally:
        conf.set(key, before)


def write_graph_by_subject(triples: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store a graph by predicate, and within each predicate in ``buckets`` by subject, sorted; the table ``name``.

    Patterns that share their subject (a star) are then joined bucket by bucket without an exchange. A bucket
    is at least one file per predicate, so their number should follow the largest predicate.
    """
    dealt = triples.repartition(buckets, "s")
    dealt.write.mode("overwrite").partitionBy("p").bucketBy(buckets, "s").sortBy("s").option("path", path).saveAsTable(name)
    return triples.sparkSession.table(name).select("s", "p", "o", "o_kind", "o_datatype")


def write_ntriples(triples: DataFrame, path: str) -> None:
    to_ntriples(triples).write.mode("overwrite").text(path)


def write_triples_tsv(triples: DataFrame, path: str) -> None:
    """Head, relation, tail of the triples whose object is an entity."""
    rows = triples.filter(F.col("o_kind") == "iri").select("s", "p", "o")
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def send_triples(triples: DataFrame, send: Callable[[str], bool], batch: int = 500, retries: int = 3,
                 delay: float = 5.0) -> None:
    """Send N-Triples text in batches from every partition, the last short batch included.

    ``send`` returns whether the batch was taken. A refused batch is tried again after
    ``delay * attempt`` seconds; when the tries run out the task fails and Spark repeats it, so
    nothing is lost in silence. Repeats are harmless because a graph is a set.
    """

    def deliver(lines: list[str]) -> None:
        error = None
        for attempt in range(1, retries + 1):
            try:
                if send("\n".join(lines)):
                    return
                error = None
            except Exception as e:  # the endpoint's client may raise anything
                error = e
            if attempt < retries:
                time.sleep(delay * attempt)
        raise RuntimeError(f"batch of {len(lines)} triples refused {retries} times") from error

    def partition(rows) -> None:
        lines: list[str] = []
        for row in rows:
            lines.append(row["line"])
            if len(lines) >= batch:
                deliver(lines)
                lines = []
        if lines:
            deliver(lines)

    to_ntriples(triples).foreachPartition(partition)


def storage_footprint(spark: SparkSession, before: str | list[str], after: str | list[str]) -> DataFrame:
    """One row: bytes before, bytes after, percent saved. File contents are not read."""

    def size(path, name):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.agg(F.sum("length").alias(name))

    sizes = size(before, "before_bytes").select(
        "before_bytes", size(after, "after_bytes").scalar().alias("after_bytes"))
    saved = (F.lit(1.0) - F.col("after_bytes") / F.nullif(F.col("before_bytes"), F.lit(0))) * 100
    return sizes.withColumn("saved_pct", saved)
