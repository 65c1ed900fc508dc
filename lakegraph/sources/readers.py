"""Schema-first readers. Nothing is inferred: every source names its columns and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path, schema, sep: str, header: bool = False, quote: str = "",
                   partitions: int | None = None) -> DataFrame:
    """Delimited text, plain or compressed, with a separator of one or more characters.

    A value that does not fit its type gives null. ``quote=""`` takes quotation marks as
    ordinary text, so a stray one cannot swallow the rest of a row. A gzip file is read by one
    task; ``partitions`` spreads its rows for what follows, unless the files already keep every core busy.
    """
    df = (
        spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", quote)
        .option("mode", "PERMISSIVE").csv(path)
    )
    busy = min(partitions or 0, spark.sparkContext.defaultParallelism)
    return df.repartition(partitions) if partitions and df.rdd.getNumPartitions() < busy else df


def read_csv(spark: SparkSession, path, schema) -> DataFrame:
    """Comma-separated text with a header and ordinary quotes."""
    return read_delimited(spark, path, schema, ",", header=True, quote='"')


def read_json_map(spark: SparkSession, path, value_schema: T.StructType, lines: bool = False) -> DataFrame:
    """``{key: record}`` documents to rows ``(key, value)``; a null record gives a null value.

    A whole-file document is one row for one task. ``lines=True`` reads one such document per
    line, which splits over tasks. A document that does not parse gives no rows; count them with
    ``unparsed_documents``.
    """
    # Exploding a named column would make Spark parse again to filter empty maps before.
    return _text(spark, path, lines).select(F.explode(_parsed(value_schema)).alias("key", "value"))


def unparsed_documents(spark: SparkSession, path, value_schema: T.StructType, lines: bool = False) -> DataFrame:
    """One row: how many documents there are and how many do not parse; blank lines are no documents."""
    documents = _text(spark, path, lines).filter(F.trim("value") != "").select(_parsed(value_schema).alias("parsed"))
    bad = F.col("parsed").isNull()
    return documents.agg(F.count("*").alias("documents"), F.count_if(bad).alias("unparsed"))


def _text(spark, path, lines):
    return spark.read.text(path, wholetext=not lines)


def _parsed(value_schema):
    return F.from_json("value", T.MapType(T.StringType(), value_schema))


def read_table(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_triples_tsv(spark: SparkSession, path) -> DataFrame:
    """Head, relation, tail."""
    return read_delimited(spark, path, "head string, relation string, tail string", "\t")


def read_entity_map(spark: SparkSession, path) -> DataFrame:
    """(id, entity) pairs; lines whose id is not all digits, such as a header, are dropped."""
    raw = read_delimited(spark, path, "id string, entity string", "\t")
    return raw.filter(F.col("id").rlike("^[0-9]+$")).select(F.col("id").cast("bigint").alias("id"), "entity")


def ontology_frame(spark: SparkSession, ontology: list[dict]) -> DataFrame:
    schema = "property string, domain string, range string, range_is_literal boolean"
    return spark.createDataFrame(
        [(r["property"], r["domain"], r["range"], r["range_is_literal"]) for r in ontology], schema)
