"""Joins, de-duplication, grouping and top-k as the graph and quality stages use them.

No join here is forced to broadcast: the lookup tables grow with the data, so the choice is left
to Catalyst's size estimate and adaptive execution, which also splits skewed join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import coalesce_id


def map_ids(df: DataFrame, links: DataFrame, key: str, link_key: str, mapped: str, out: str) -> DataFrame:
    """Left join of ``key`` with ``link_key`` as text; ``out`` is the mapped id or the key itself.

    Several links for one key give several rows.
    """
    right = links.select(F.col(link_key).cast("string").alias("_link"), F.col(mapped).alias("_mapped"))
    joined = df.join(right, F.col(key).cast("string") == F.col("_link"), "left")
    return joined.withColumn(out, coalesce_id(F.col("_mapped"), F.col(key))).drop("_link", "_mapped")


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def union_distinct(col: str, *frames: DataFrame, na_tokens=("", "\\N")) -> DataFrame:
    """Distinct values of the first column of each frame, without missing ones."""
    out = None
    for f in frames:
        part = f.select(F.col(f.columns[0]).alias(col))
        out = part if out is None else out.union(part)
    return out.filter(F.col(col).isNotNull() & ~F.col(col).isin(*na_tokens)).distinct()


def drop_duplicates_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def group_count(df: DataFrame, by: list[str], counted: str, name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(counted).alias(name))


def group_sum(df: DataFrame, by: list[str], measure: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(measure).alias(name))


def top_k(df: DataFrame, by: str, measure: str, k: int, name: str = "total") -> DataFrame:
    """The ``k`` values of ``by`` with the largest sum of ``measure``; ties in name order."""
    return group_sum(df, [by], measure, name).orderBy(F.desc(name), by).limit(k)


def pivot_fill(df: DataFrame, index: str, column: str, value: str, values: list | None = None) -> DataFrame:
    """Cross table with 0 for missing cells. Naming ``values`` saves the job that finds them.

    Without them the names in ``column`` are looked up, at most ``spark.sql.pivotMaxValues`` (10,000): more
    are an error, as a table cannot have a column for each.
    """
    pivoted = df.groupBy(index).pivot(column, values) if values else df.groupBy(index).pivot(column)
    return pivoted.agg(F.first(value)).na.fill(0)


def date_range(df: DataFrame, col: str) -> DataFrame:
    day = F.to_date(F.col(col))
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))
