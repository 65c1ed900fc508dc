"""Joins, set operations, grouping, sorting, top-k, de-duplication."""

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.incremental import incremental_merge as merge
from . import query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  coalesce(CASE WHEN p_type <> 'ECONOMY' THEN 'tt' || p_partkey::VARCHAR END, l_partkey::VARCHAR) AS known_for
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def map_ids_left(t):
    """Parts of one type have no mapped id, so their own number stays."""
    links = t.part.filter("p_type <> 'ECONOMY'").select(
        F.col("p_partkey").cast("string").alias("link"), F.concat(F.lit("tt"), "p_partkey").alias("mapped"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rel.map_ids(items, links, "l_partkey", "link", "mapped", "known_for")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
  (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_join(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.semi_join(t.customer.select("c_custkey", "c_name"), urgent, "c_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def anti_join(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.anti_join(t.customer.select("c_custkey", "c_name"), urgent, "c_custkey")


@query("SELECT l_partkey::VARCHAR AS id FROM lineitem UNION SELECT l_suppkey::VARCHAR FROM lineitem")
def union_distinct(t):
    ids = lambda c: t.lineitem.select(F.col(c).cast("string"))
    return rel.union_distinct("id", ids("l_partkey"), ids("l_suppkey"))


@query("""WITH existing AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT id, name FROM existing UNION ALL
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM existing)""")
def incremental_merge(t):
    """Suppliers are added unless a customer of one segment already has the number."""
    existing = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge(existing, new, "id")


@query("SELECT c_nationkey, c_mktsegment, count(c_custkey) AS n FROM customer GROUP BY ALL")
def group_count(t):
    return rel.group_count(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey", "n")


@query("SELECT p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY p_brand")
def group_sum(t):
    return rel.group_sum(t.part, ["p_brand"], "p_size", "total")


@query("""SELECT p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY p_brand
ORDER BY total DESC, p_brand LIMIT 5""")
def top_k(t):
    return rel.top_k(t.part, "p_brand", "p_size", 5)


@query("""SELECT c_nationkey, """ + ", ".join(
    f"coalesce(sum(CASE WHEN c_mktsegment = '{s}' THEN 1 END), 0)::BIGINT AS \"{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY c_nationkey")
def pivot_fill(t):
    counts = rel.group_count(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey", "n")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return rel.pivot_fill(counts, "c_nationkey", "c_mktsegment", "n", segments)


@query("SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates(t):
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1""")
def drop_duplicates_by_key(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_extendedprice")]
    return rel.drop_duplicates_by_key(items, ["l_orderkey"], order)


@query("SELECT DISTINCT l_partkey FROM lineitem")
def distinct_values(t):
    return t.lineitem.select("l_partkey").distinct()


@query("SELECT count(*) AS n FROM lineitem")
def row_count(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT min(o_orderdate)::DATE::VARCHAR AS min_date, max(o_orderdate)::DATE::VARCHAR AS max_date FROM orders")
def date_range(t):
    return rel.date_range(t.orders, "o_orderdate").select(*[F.col(c).cast("string") for c in ("min_date", "max_date")])


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_limit(t):
    rows = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
