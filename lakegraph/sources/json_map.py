"""One JSON document ``{key: record, ...}`` of any size, read by many tasks.

The file is split by the text reader at closing braces. What a piece means depends on whether it begins
inside a quoted string and how deep it is nested, so each piece says what it does from either state:
the quotes it holds flip the state, the braces outside of quotes change the depth. Sums of that within a
split, and over the few rows with one split each, give every piece its true state; a record ends where the
depth comes back to one. Only records that cross the border of a split are put together from two tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.ordering import stored

_SPLIT = ("file", "block")


def _pieces(spark: SparkSession, path) -> DataFrame:
    """Text up to each closing brace, with its split and a number that grows within it."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), "value")


def _effects(pieces: DataFrame) -> DataFrame:
    """``quotes``, and the change of depth from outside and from inside a string, the closing brace included."""
    bare = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("_parts", F.split(bare, '"'))

    def opened(odd: int):
        outside = F.array_join(F.filter("_parts", lambda x, i: i % 2 == odd), "")
        return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    quotes = F.size("_parts") - 1
    closes = lambda odd: F.when(quotes % 2 == odd, 1).otherwise(0)
    return pieces.withColumns({"quotes": quotes, "d_out": opened(0) - closes(0), "d_in": opened(1) - closes(1)}).drop("_parts")


def _placed(pieces: DataFrame, start: dict) -> DataFrame:
    """Pieces with ``quoted``, whether they begin in a string, and the ``depth`` after them, from the state of their split."""
    rows = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("quotes").over(rows) - F.col("quotes")
    pieces = pieces.withColumn("quoted", (start["quotes"] + before) % 2 == 1)
    pieces = pieces.withColumn("d", F.when(F.col("quoted"), F.col("d_in")).otherwise(F.col("d_out")))
    return pieces.withColumn("depth", start["depth"] + F.sum("d").over(rows))


def _starts(spark: SparkSession, path) -> DataFrame:
    """One row per split: its state and the number of records that ended before it, and whether its file is whole."""
    narrow = stored(_effects(_pieces(spark, path)).drop("value"), "json-pieces")
    zero, before = F.lit(0).cast("long"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sides = [_placed(narrow, {"quotes": F.lit(q), "depth": zero}).groupBy(*_SPLIT).agg(
        F.sum("quotes").alias("n_quotes"), F.sum("d").alias(f"d{q}")) for q in (0, 1)]
    splits = sides[0].join(sides[1].drop("n_quotes"), list(_SPLIT))
    splits = splits.withColumn("s_quotes", F.coalesce(F.sum("n_quotes").over(before), zero) % 2)
    change = F.when(F.col("s_quotes") == 1, F.col("d1")).otherwise(F.col("d0"))
    splits = stored(splits.withColumn("s_depth", F.coalesce(F.sum(change).over(before), zero)).select(
        *_SPLIT, "s_quotes", "s_depth", (F.col("s_depth") + change).alias("e_depth"), ((F.col("s_quotes") + F.col("n_quotes")) % 2).alias("e_quotes")), "json-splits")

    placed = _placed(narrow.join(splits, list(_SPLIT)), {"quotes": F.col("s_quotes"), "depth": F.col("s_depth")})
    ended = placed.groupBy(*_SPLIT).agg(F.count_if(_ends()).alias("n_ends"))
    whole = Window.partitionBy("file")
    last = F.max_by(F.struct("e_depth", "e_quotes"), "block").over(whole)
    # The reader takes the end of the file for a brace too, so what follows the document counts as one more.
    good = last["e_depth"].isin(0, -1) & (last["e_quotes"] == 0)
    return stored(splits.join(ended, list(_SPLIT)).withColumns({
        "s_ends": F.coalesce(F.sum("n_ends").over(before), zero), "good": good}), "json-splits")


def _ends():
    """The piece's brace is outside of strings and closes a record."""
    return ((F.col("quoted").cast("int") + F.col("quotes")) % 2 == 0) & (F.col("depth") == 1)


def _opens():
    """The piece begins the document."""
    return (F.col("block") == 0) & (F.col("depth") == F.col("d")) & F.rlike("value", F.lit(r"^\s*\{"))


def json_map_records(spark: SparkSession, path) -> DataFrame:
    """(file, record, text): the entries of whole documents as small documents ``{key: record}``.

    Entries without a brace (null records) come with the next entry that has one. A document that breaks
    off gives no rows.
    """
    starts = _starts(spark, path).filter("good").select(*_SPLIT, "s_quotes", "s_depth", "s_ends")
    pieces = _effects(_pieces(spark, path)).join(starts, list(_SPLIT))
    placed = _placed(pieces, {"quotes": F.col("s_quotes"), "depth": F.col("s_depth")})
    rows = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("ends", _ends())
    local = F.count_if(F.col("ends")).over(rows) - F.col("ends").cast("long")
    # After the document's own brace there is nothing to read.
    inside = placed.withColumn("local", local).filter((F.col("depth") > F.col("d")) | _opens())
    parts = inside.groupBy(*_SPLIT, (F.col("s_ends") + F.col("local")).alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.max("ends").alias("ends"), F.min("local").alias("local"))
    parts = parts.select(*_SPLIT, "record", "ends", "local", F.array_join(F.col("p.value"), "}").alias("text"))
    alone = F.col("ends") & (F.col("local") > 0)
    whole = parts.filter(alone).select("file", "record", "text", "ends")
    cut = parts.filter(~alone).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("ends").alias("ends")).select(
        "file", "record", F.array_join(F.col("p.text"), "}").alias("text"), "ends")
    text = F.regexp_replace("text", r"^\s*[{,]?\s*", "")
    found = whole.unionByName(cut).select("file", "record", text.alias("text"), "ends").filter("text <> ''")
    return found.select("file", "record", F.concat(F.lit("{"), "text", F.when(F.col("ends"), "}}").otherwise("}")).alias("text"))


def read_json_map_whole(spark: SparkSession, path, value_schema: T.StructType) -> DataFrame:
    """``{key: record}`` documents, a file each, to rows (key, value); a null record gives a null value.

    Values are objects or null. Every split of a file is a task of its own. Entries that do not parse
    and documents that break off give no rows: count them with ``unparsed_records``. A key that occurs
    twice in a document gives two rows. Compressed files are one split.
    """
    return _parsed(spark, path, value_schema).select(F.explode("parsed").alias("key", "value"))


def unparsed_records(spark: SparkSession, path, value_schema: T.StructType) -> DataFrame:
    """One row: documents, those that break off, pieces of the others that were read as entries, and those that do not parse."""
    files = _starts(spark, path).groupBy("file").agg(F.max("good").alias("good"))
    records = _parsed(spark, path, value_schema).agg(F.count("*").alias("entries"), F.count_if(F.col("parsed").isNull()).alias("unparsed"))
    return files.agg(F.count("*").alias("documents"), F.count_if(~F.col("good")).alias("broken")).select(
        "documents", "broken", records.select("entries").scalar().alias("entries"), records.select("unparsed").scalar().alias("unparsed"))


def _parsed(spark, path, value_schema):
    return json_map_records(spark, path).select(F.from_json("text", T.MapType(T.StringType(), value_schema)).alias("parsed"))
