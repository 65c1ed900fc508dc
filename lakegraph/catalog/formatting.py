"""Projections and scalar functions."""

from pyspark.sql import functions as F

from ..functions import text, values
from . import query

_NA = "('', 'NA', 'N/A', 'NaN', 'NULL')"


def _clean_sql(c):
    t = f"trim(regexp_replace({c}, '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {t} IN {_NA} THEN NULL ELSE {t} END AS {c}"


@query(f"SELECT doc_id, {_clean_sql('text')}, {_clean_sql('lang')}, {_clean_sql('source')} FROM documents")
def clean_strings(t):
    return text.clean_strings(t.documents.select("doc_id", "text", "lang", "source"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority
FROM orders""")
def normalize_na(t):
    tokens = text.NA_TOKENS + ("4-NOT SPECIFIED",)
    return t.orders.select("o_orderkey", text.normalize_na(F.col("o_orderpriority"), tokens).alias("priority"))


def _accents_sql():
    out = "text"
    for ch, ascii_text in {**text.ASCII_SINGLE, **text.ASCII_MULTI}.items():
        out = f"replace({out}, '{ch}', '{ascii_text.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT doc_id, nullif(strip_accents({out}), '') AS text FROM documents"


@query(_accents_sql())
def strip_accents(t):
    return t.documents.select("doc_id", "text").select("doc_id", text.strip_accents(F.col("text")).alias("text"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_name
  ELSE p_name || ' (' || (1950 + p_size)::VARCHAR || ')' END AS title FROM part)
SELECT p_partkey, regexp_replace(title, '\\s*\\(\\d{4}\\)$', '') AS title,
  TRY_CAST(regexp_extract(title, '\\((\\d{4})\\)$', 1) AS INTEGER) AS year FROM t""")
def split_title_year(t):
    titled = F.concat("p_name", F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    part = t.part.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).otherwise(titled).alias("title"))
    return text.split_title_year(part, "title", "year")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def split_explode(t):
    words = t.part.select("p_partkey", text.split_to_array(F.col("p_name"), " ").alias("words"))
    return values.explode_list(words, "words", "word")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS word
FROM orders""")
def explode_list_keep_empty(t):
    """Orders without a priority have an empty list and keep their row."""
    tokens = ("4-NOT SPECIFIED",)
    lists = t.orders.select("o_orderkey", text.clean_array(F.array("o_orderpriority"), tokens).alias("words"))
    return values.explode_list(lists, "words", "word", keep_empty=True)


@query("""SELECT o_orderkey, array_to_string(list_filter([o_orderpriority, o_orderstatus, NULL, ''],
  lambda x: x IS NOT NULL AND x <> '' AND x <> '4-NOT SPECIFIED'), '|') AS tags FROM orders""")
def clean_array(t):
    tags = F.array("o_orderpriority", "o_orderstatus", F.lit(None), F.lit(""))
    cleaned = text.clean_array(tags, ("", "4-NOT SPECIFIED"))
    return t.orders.select("o_orderkey", F.array_join(cleaned, "|").alias("tags"))


@query("SELECT c_custkey, 'nm' || c_custkey::VARCHAR AS person_id FROM customer")
def prefix_id(t):
    return t.customer.select("c_custkey", text.prefix_id(F.col("c_custkey").cast("string"), "nm").alias("person_id"))


@query("""SELECT o_orderkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
  WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN 'Non-binary' END AS label,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = 1 AS is_first FROM orders""")
def code_labels(t):
    """Priority digits read as codes; 4 and 5 are not in the table of labels."""
    code = values.safe_cast(F.substring("o_orderpriority", 1, 1), "int")
    labels = values.map_codes(code, {1: "Female", 2: "Male", 3: "Non-binary"})
    return t.orders.select("o_orderkey", labels.alias("label"), values.flag_to_boolean(code).alias("is_first"))


@query("""SELECT c_custkey, TRY_CAST(c_name AS INTEGER) AS bad, TRY_CAST(string_split(c_name, '#')[2] AS INTEGER) AS good
FROM customer""")
def safe_cast(t):
    number = F.element_at(F.split("c_name", "#"), 2)
    return t.customer.select("c_custkey", values.safe_cast(F.col("c_name"), "int").alias("bad"),
                             values.safe_cast(number, "int").alias("good"))


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS moment FROM events
UNION ALL SELECT event_id, NULL FROM events""")
def epoch_format(t):
    """Epoch seconds as text, once for every event and once as text that is no number."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    epochs = t.events.select("event_id", F.explode(F.array(seconds, F.col("event_type"))).alias("epoch"))
    moment = values.epoch_to_timestamp(F.col("epoch"))
    return epochs.select("event_id", values.format_timestamp(moment).alias("moment"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS kind FROM events")
def json_flatten(t):
    parsed = t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("props"))
    return values.flatten_struct(parsed, {"event_id": "event_id", "k": "props.k", "kind": "event_type"})


@query("""SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS id,
  unnest([l_quantity, l_tax]) AS popularity FROM lineitem""")
def project_nested(t):
    """Records of three fields and a missing one, cut down to two fields."""
    def record(i, p):
        return F.struct(F.col(i).alias("id"), F.col(p).alias("popularity"), F.col("l_returnflag").alias("overview"))

    works = F.array(record("l_partkey", "l_quantity"), F.lit(None), record("l_suppkey", "l_tax"))
    cut = t.lineitem.select("l_orderkey", "l_linenumber", values.project_nested(works, "id", "popularity").alias("works"))
    rows = values.explode_list(cut, "works", "work")
    return rows.select("l_orderkey", "l_linenumber", "work.id", "work.popularity")


@query("SELECT o_orderkey, CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade FROM orders")
def decade_of(t):
    return t.orders.select("o_orderkey", values.decade_of(F.year("o_orderdate")).alias("decade"))


@query("SELECT o_orderdate::DATE::VARCHAR AS day, o_orderkey FROM orders")
def select_columns(t):
    """Reorder and drop; a column to drop that does not exist is no error."""
    df = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return values.select_columns(df, ["day", "o_orderkey", "o_totalprice"], ("o_totalprice", "not_there"))
