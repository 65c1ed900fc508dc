"""Loading only what is new: by file content and by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import stored

MANIFEST_SCHEMA = "name string, length bigint, modified timestamp, digest string"
_INDEX_BITS = 33  # of a row within its partition, in monotonically_increasing_id


def list_files(spark: SparkSession, paths, name: Column | None = None) -> DataFrame:
    """(name, path, uri, length, modified) of files; their contents are not read.

    ``name`` is the path, or made of it; ``uri`` is the path as other readers report it. Empty files are not
    listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select((F.col("path") if name is None else name).alias("name"), "path", F.col("_metadata.file_path").alias("uri"),
                        "length", F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, paths) -> DataFrame:
    """(path, digest) of files of any size, each read by as many tasks as it has splits.

    Every line is hashed (SHA-256, cut to four numbers of 32 bits). A split sums its hashes, and its hashes times
    the line's place in it. From these few rows the sums over a whole file follow with the place in the
    file, so the digest does not depend on how it was split, and a line that is changed, added, taken away or
    moved changes it. Compressed text is hashed as the text it holds, by one task. Empty files are not listed.
    """
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
    place = F.monotonically_increasing_id().bitwiseAND((1 << _INDEX_BITS) - 1)
    lines = text.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                        place.alias("place"), F.sha2(F.col("value").cast("binary"), 256).alias("hash"))
    lanes = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)") for i in range(4)]
    splits = lines.groupBy("uri", "block").agg(
        F.count("*").alias("n"), F.min("place").alias("start"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(lanes)],
        *[F.sum((h * F.col("place").cast("decimal(10,0)")).cast("decimal(28,0)")).alias(f"p{i}") for i, h in enumerate(lanes)])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = (before - F.col("start")).cast("decimal(16,0)")
    placed = splits.select("uri", "n", *[f"h{i}" for i in range(4)], *[
        (F.col(f"p{i}") + (F.col(f"h{i}") * moved).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    sums = placed.groupBy("uri").agg(F.sum("n").alias("n"), *[F.sum(f"{c}{i}").cast("decimal(38,0)").alias(f"{c}{i}") for c in "hp" for i in range(4)])
    listed = list_files(spark, paths).select("path", "uri")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", *[f"{c}{i}" for c in "hp" for i in range(4)])]
    return listed.join(sums, "uri", "left").select("path", F.sha2(F.concat_ws(",", *parts), 256).alias("digest"))


def detect_changed_files(spark: SparkSession, paths, manifest: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """(name, path, length, modified, digest, status): ``new``, ``changed`` or ``unchanged`` against the stored manifest.

    A file of the same length and time as before is unchanged and not read; the others are hashed, so a file
    that was only touched, or written again with the same text, is unchanged too. The manifest goes by
    ``name`` (the path by default). Store the new entries with ``update_manifest`` only after the files are
    processed.
    """
    manifest = spark.createDataFrame([], MANIFEST_SCHEMA) if manifest is None else manifest
    known = manifest.select("name", F.col("length").alias("_length"), F.col("modified").alias("_modified"), F.col("digest").alias("_digest"))
    found = stored(list_files(spark, paths, name).join(known, "name", "left"), "files")
    same = F.coalesce((F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified")), F.lit(False))
    asked = [r["path"] for r in found.filter(~same).select("path").collect()]  # names only, as many as the listing has
    digests = file_digests(spark, asked) if asked else spark.createDataFrame([], "path string, digest string")
    joined = found.join(digests, "path", "left")
    digest = F.coalesce("digest", "_digest")
    status = F.when(F.col("_digest").isNull(), "new").when(digest != F.col("_digest"), "changed").otherwise("unchanged")
    return joined.select("name", "path", "length", "modified", digest.alias("digest"), status.alias("status"))


def update_manifest(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """The stored entries with those of the processed files put in."""
    columns = ("name", "length", "modified", "digest")
    return manifest.join(processed, "name", "left_anti").select(*columns).unionByName(processed.select(*columns))


def missing_inputs(spark: SparkSession, expected: DataFrame, paths, level: int = -1) -> DataFrame:
    """Names in ``expected(name)`` that no file under ``paths`` has, or no folder ``level`` steps from the end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    have = files.select(F.element_at(F.split("path", "/"), level).alias("name")).distinct()
    return expected.select("name").join(have, "name", "left_anti")


def incremental_merge(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing keys stay as they are (also those whose lookup found nothing); new keys are added.

    Of several new rows with one key the first in the order of the other columns is added, nulls first.
    """
    columns = existing.columns
    added = new.join(existing.select(key), key, "left_anti")
    one = added.groupBy(key).agg(F.min(F.struct(*[c for c in columns if c != key])).alias("_row"))
    fresh = one.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in columns])
    return existing.unionByName(fresh)
