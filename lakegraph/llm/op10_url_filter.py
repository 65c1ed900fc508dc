"""URL filter: host and path rules, then a blocked Bloom filter and an exact join with a list of URLs.

The list's canonical URLs set eight bits each, one in every word of a single block of 256 bits; blocks
are made by ``bit_or`` with partial aggregation. Their number follows the length of the list, so about one in
a hundred other URLs passes at every length. A filter of at most ``BROADCAST_BLOCKS`` is broadcast, a
larger one is joined by block number. What passes is joined exactly with the list, which removes the
false positives. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.shared import LOWER, UPPER, stored, table

# Rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
WORDS = 8
# Listed URLs for each block of 256 bits, and blocks (of about 80 bytes as rows) that are broadcast at most.
URLS_PER_BLOCK, BROADCAST_BLOCKS = 20, 1 << 16


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without its last slashes, query without ``utm_`` parameters; null without ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    short = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit a key has in a word of its block."""
    return F.element_at(F.array(*[F.lit(1 << b) for b in range(32)]), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(32)).cast("int") + 1).cast("long")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` from ``listed(listed_url)``."""
    return listed.groupBy(_block(F.col("listed_url"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("listed_url"), i)).alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages(page_id, url)``.

    ``listed`` has one column of URLs to block; they are made canonical, nulls are ignored, repeats count
    once. The longest rule decides; without one, a URL whose canonical form is listed is blocked, any
    other allowed. A null URL, or one without ``://``, has an empty host and path, fits no rule that
    asks for a path, and is not listed. Repeated rows are judged one by one; other columns are ignored.
    """
    listed = stored(listed.toDF("u").select(canonical(F.col("u")).alias("listed_url")).filter("listed_url is not null").distinct(), "listed-urls")
    n = max(1, math.ceil(listed.count() / URLS_PER_BLOCK))
    blocks = stored(bloom_filter(listed, n), "bloom-filter")
    rows = pages.select("page_id", "url", canonical(F.col("url")).alias("key"))
    passed = F.coalesce(reduce(and_, [F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0 for i in range(WORDS)]), F.lit(False))
    # Rows without a key have no block; where they are many, adaptive execution splits them.
    rows = rows.withColumn("block", F.when(F.col("key").isNotNull(), _block(F.col("key"), n)))
    rows = rows.join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, "block", "left").select("page_id", "url", "key", passed.alias("passed"))
    sure = rows.filter("not passed").select("page_id", "url", F.lit(False).alias("listed"))
    hits = rows.filter("passed").join(listed, F.col("key") == F.col("listed_url"), "left").select(
        "page_id", "url", F.col("listed_url").isNotNull().alias("listed"))
    judged = sure.union(hits).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "listed")
    judged = judged.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("m.rule").alias("rule"),
                         F.coalesce("m.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list is made of the canonical URLs that more than one page has."""
    pages = table(spark, sf_dir, "pages")
    repeated = pages.select("url", canonical(F.col("url")).alias("key")).filter("key is not null").groupBy("key").agg(
        F.min("url").alias("url"), F.count("*").alias("n")).filter("n > 1").select("url")
    return judge(pages, repeated)


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH cut AS (
  SELECT page_id, url, row_number() OVER () AS r,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, r, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, rest,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS query
  FROM cut),
keyed AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
                      || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM parts),
listed AS (SELECT key FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
rules(h, p, v) AS (VALUES {_RULES_SQL}),
fitting AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, listed.key IS NOT NULL AS listed,
       coalesce(verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN fitting USING (r) LEFT JOIN listed ON keyed.key = listed.key
"""
