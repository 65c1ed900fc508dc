"""Readers, writers and incremental loading, on the table files and on copies Spark writes."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.triples import Attr, Mapping, Node, set_of_triples
from ..plans import movies as m
from ..session import work_path
from ..sources import incremental, json_map, outbox, readers, sinks
from . import query
from .quality import titles
from .graph import TITLE_PARTS, _TITLES, _set

# Rows that one task sorts on the way to a file that one task writes.
ROWS_OF_RANGE = 2_000_000
_ORDERS = "SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status FROM orders"


def _orders(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query(_ORDERS)
def read_two_char_separator(t):
    path = work_path(t.spark, "dat")
    _orders(t).select(F.concat_ws("::", "o_orderkey", "priority", "status").alias("value")).write.text(path)
    return readers.read_delimited(t.spark, path, "o_orderkey bigint, priority string, status string", "::")


@query("""SELECT o_orderkey, NULL::INTEGER AS priority, '"' || o_orderstatus AS status FROM orders""")
def read_gzip_tsv(t):
    """Compressed, with a header, a value that does not fit its type, and an unclosed quote."""
    path = work_path(t.spark, "tsv")
    rows = _orders(t).withColumn("status", F.concat(F.lit('"'), "status"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("compression", "gzip").csv(path)
    schema = "o_orderkey bigint, priority int, status string"
    return readers.read_delimited(t.spark, path, schema, "\t", header=True)


@query(_ORDERS)
def write_read_csv(t):
    path = work_path(t.spark, "csv")
    sinks.write_csv(_orders(t), path)
    return readers.read_csv(t.spark, path, "o_orderkey bigint, priority string, status string")


@query(_ORDERS)
def write_read_table(t):
    path = work_path(t.spark, "table")
    sinks.write_table(_orders(t), path)
    return readers.read_table(t.spark, path)


@query("""SELECT l_orderkey::VARCHAR AS key, l_suppkey AS id, unnest([l_partkey, l_orderkey]) AS work,
  unnest([l_quantity, l_tax]) AS popularity FROM lineitem UNION ALL SELECT l_orderkey::VARCHAR, NULL, NULL, NULL FROM lineitem
WHERE l_linestatus = 'O'""")
def read_json_map(t):
    """Every line item as a document ``{key: record}``; open ones bring a second document with no record."""
    path = work_path(t.spark, "json")
    work = lambda i, p: F.struct(F.col(i).alias("id"), F.col(p).alias("popularity"))
    record = F.struct(F.col("l_suppkey").alias("id"),
                      F.array(work("l_partkey", "l_quantity"), work("l_orderkey", "l_tax")).alias("known_for"))
    key = F.col("l_orderkey").cast("string")
    full = F.to_json(F.create_map(key, record))
    empty = F.when(F.col("l_linestatus") == "O", F.concat(F.lit('{"'), key, F.lit('": null}')))
    documents = F.filter(F.array(full, empty), lambda x: x.isNotNull())
    t.lineitem.select(F.explode(documents).alias("value")).write.text(path)
    schema = T._parse_datatype_string("id bigint, known_for array<struct<id bigint, popularity double>>")
    rows = readers.read_json_map(t.spark, path, schema, lines=True)
    works = rows.select("key", "value.id", F.explode_outer("value.known_for").alias("w"))
    return works.select("key", "id", F.col("w.id").alias("work"), F.col("w.popularity").alias("popularity"))


@query(_set(_TITLES, *TITLE_PARTS))
def store_triples(t):
    """A graph stored by predicate and read back."""
    path = work_path(t.spark, "graph")
    sinks.write_triples(set_of_triples((titles(t), m.titles_mapping())), path)
    return readers.read_table(t.spark, path).select("s", "p", "o", "o_kind", "o_datatype")


@query("SELECT s AS head, p AS relation, o AS tail FROM (" + _set(_TITLES, *TITLE_PARTS) + ") WHERE o_kind = 'iri'")
def triples_tsv(t):
    path = work_path(t.spark, "triples")
    sinks.write_triples_tsv(set_of_triples((titles(t), m.titles_mapping())), path)
    return readers.read_triples_tsv(t.spark, path)


@query("SELECT c_custkey AS id, c_name AS entity FROM customer")
def read_entity_map(t):
    """Every row also comes once with an id that is no number."""
    path = work_path(t.spark, "entities")
    ids = F.explode(F.array(F.col("c_custkey").cast("string"), F.concat(F.lit("id"), "c_custkey")))
    rows = t.customer.select(ids.alias("id"), F.col("c_name").alias("entity"))
    rows.write.option("sep", "\t").csv(path)
    return readers.read_entity_map(t.spark, path)


@query("""SELECT 'nation=' || c_nationkey AS name, CASE WHEN c_nationkey >= 20 THEN 'new'
  WHEN max(c_acctbal) > 9800 OR min(c_custkey) < 5 THEN 'changed' ELSE 'unchanged' END AS status FROM customer GROUP BY c_nationkey""")
def changed_files(t):
    """Customers in one file per nation, twice: rich ones change their segment, the first ones change places.

    The first load had no nation above 19. Files are told apart by their folder, so the second load is
    compared by content and not by the names that its files happen to get.
    """
    def load(rows, place):
        path = work_path(t.spark, "customers")
        line = F.concat_ws("|", "c_custkey", "c_name", "segment")
        dealt = rows.select(F.concat(F.lit("nation="), "c_nationkey").alias("folder"), line.alias("line"), place.alias("place"))
        dealt.repartition("folder").sortWithinPartitions("folder", "place", "line").select("line", F.col("folder").alias("f")).write.partitionBy("f").text(path)
        return path
    segment, rich = F.col("c_mktsegment"), F.col("c_acctbal") > 9800
    first = load(t.customer.filter("c_nationkey < 20").withColumn("segment", segment), F.col("c_custkey"))
    second = load(t.customer.withColumn("segment", F.when(rich, F.concat(segment, F.lit("!"))).otherwise(segment)),
                  F.when(F.col("c_custkey") < 5, 1 << 40).otherwise(0) + F.col("c_custkey"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^f=|%3D", "")
    manifest = incremental.detect_changed_files(t.spark, first, name=name)
    found = incremental.detect_changed_files(t.spark, second, manifest.select("name", "length", "modified", "digest"), name)
    return found.select(F.regexp_replace("name", "^nation", "nation=").alias("name"), "status")


@query("""SELECT 'order ' || o_orderkey AS key, o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a "} , {' || o_orderstatus END AS note, o_totalprice AS price FROM orders UNION ALL SELECT 'none ' || o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'""")
def read_json_map_whole(t):
    """All orders as one document in one file, pretty-printed, with braces in texts and entries without a record."""
    path, sorted_ = work_path(t.spark, "document"), work_path(t.spark, "document-rows")
    # Ranges of rows are sorted by a task each; the one that writes the file only reads them one after the other.
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // ROWS_OF_RANGE)), "o_orderkey").withColumn("range", F.spark_partition_id())
    ranges.sortWithinPartitions("range", "o_orderkey").write.partitionBy("range").parquet(sorted_)
    found = t.spark.read.schema(ranges.schema).parquet(sorted_).select("range").distinct().collect()  # one row per range
    parts = [t.spark.read.schema(rows.schema).parquet(f"{sorted_}/range={i}") for i in sorted(r["range"] for r in found)]
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a "} , {'), "o_orderstatus"))
    record = F.struct(F.col("o_custkey").alias("id"), F.struct(note.alias("note"), F.col("o_totalprice").alias("price")).alias("more"))
    entry = F.concat(F.lit('"order '), "o_orderkey", F.lit('" : '), F.to_json(record))
    empty = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('"none '), "o_orderkey", F.lit('": null')))
    line, first = F.concat_ws(",\n", entry, empty), t.orders.agg(F.min("o_orderkey")).first()[0]
    lines = [x.select(F.concat(F.when(F.col("o_orderkey") == first, "{ ").otherwise(","), line).alias("value")) for x in parts]
    close = t.spark.range(0, 1, 1, 1).select(F.lit("}").alias("value"))
    reduce(lambda a, b: a.union(b), [*lines, close]).coalesce(1).write.text(path)
    schema = T._parse_datatype_string("id bigint, more struct<note string, price double>")
    return json_map.read_json_map_whole(t.spark, path, schema).select("key", "value.id", "value.more.note", "value.more.price")


@query("""SELECT 's_nationkey=' || n_nationkey AS name FROM nation
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IS NOT NULL)""")
def missing_inputs(t):
    """Rich suppliers stored by nation; the nations that should have a folder and have none."""
    path = work_path(t.spark, "by-nation")
    t.supplier.filter("s_acctbal > 5000").write.partitionBy("s_nationkey").parquet(path)
    return incremental.missing_inputs(t.spark, t.nation.select(F.concat(F.lit("s_nationkey="), "n_nationkey").alias("name")), path, -2)


@query("""WITH old AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_custkey, o_orderkey FROM old UNION ALL
SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM old) GROUP BY o_custkey""")
def merge_new_keys(t):
    """Customers known by their last finished order; of those not known, one of all their orders is added."""
    known = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return incremental.incremental_merge(known, t.orders.select("o_custkey", "o_orderkey"), "o_custkey")


@query("""SELECT count(*) AS documents, count(*) FILTER (l_returnflag = 'R') AS unparsed FROM lineitem""")
def unparsed_documents(t):
    """A document per line item; those of returned items break off."""
    path = work_path(t.spark, "json")
    whole = F.to_json(F.create_map(F.col("l_orderkey").cast("string"), F.struct("l_suppkey")))
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit('{"'), "l_orderkey")).otherwise(whole)
    t.lineitem.select(text.alias("value")).write.text(path)
    return readers.unparsed_documents(t.spark, path, T._parse_datatype_string("l_suppkey bigint"), lines=True)


@query("SELECT true AS shrinks, true AS as_defined")
def storage_footprint(t):
    """Text of all line items against the same rows as Parquet: smaller, and the saving is what its definition says."""
    before, after = work_path(t.spark, "before"), work_path(t.spark, "after")
    rows = t.lineitem.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    sinks.write_csv(rows, before)
    sinks.write_table(rows, after)
    size = sinks.storage_footprint(t.spark, before, after)
    saved = 100 * (F.col("before_bytes") - F.col("after_bytes")) / F.col("before_bytes")
    return size.select(((F.col("after_bytes") > 0) & (F.col("after_bytes") < F.col("before_bytes"))).alias("shrinks"),
                       (F.abs(F.col("saved_pct") - saved) < 1e-6).alias("as_defined"))


@query("""SELECT b AS before_bytes, a AS after_bytes, round(100 * (b - a) / b, 6) AS saved_pct FROM (
  SELECT sum(strlen(l_comment) + 1)::BIGINT AS b, sum(strlen(l_comment) + 1) FILTER (l_linenumber = 1)::BIGINT AS a
  FROM (SELECT l_orderkey || ' ' || l_partkey || ' ' || l_returnflag AS l_comment, l_linenumber FROM lineitem))""")
def storage_bytes(t):
    """Line items as lines of text, all of them and the first of each order: bytes follow from the rows."""
    before, after = work_path(t.spark, "before"), work_path(t.spark, "after")
    line = F.concat_ws(" ", "l_orderkey", "l_partkey", "l_returnflag").alias("value")
    t.lineitem.select(line).write.text(before)
    t.lineitem.filter("l_linenumber = 1").select(line).write.text(after)
    return sinks.storage_footprint(t.spark, before, after).select("before_bytes", "after_bytes", F.round("saved_pct", 6).alias("saved_pct"))


@query("""SELECT 1 AS run, o_orderstatus = 'F' AS old, count(*) AS triples FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
UNION ALL SELECT 2, false, count(*) FROM orders WHERE o_orderstatus <> 'F'""")
def send_once(t):
    """Finished orders are sent, then all orders: the second run sends what the first did not, every triple once."""
    boxes, ledger = work_path(t.spark, "boxes"), work_path(t.spark, "ledger")
    work = Node("Movie", "o_orderkey")
    triples = lambda rows: set_of_triples((rows, Mapping((Attr(work, "status", "o_orderstatus"),))))
    outbox.fill_outbox(triples(t.orders.filter("o_orderstatus = 'F'")), boxes)
    outbox.send_outbox(t.spark, boxes, ledger, lambda text: len(text) % 3 > 0, retries=1)
    outbox.send_outbox(t.spark, boxes, ledger, lambda text: True)
    outbox.fill_outbox(triples(t.orders), boxes)
    outbox.send_outbox(t.spark, boxes, ledger, lambda text: True)
    sent = outbox.read_ledger(t.spark, ledger).filter("delivered")
    rows = t.spark.read.schema("number bigint, line string, outbox string").parquet(boxes)
    named = rows.select(F.concat_ws("/", "outbox", F.col("number").cast("string")).alias("batch"), F.col("line").contains('"F"').alias("old"))
    return sent.join(named, "batch").groupBy(F.when(F.col("run") < 3, 1).otherwise(2).alias("run"), "old").agg(F.count("*").alias("triples"))
