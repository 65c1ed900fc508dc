"""Profiles and data-quality metrics, each in one pass over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted

# The statistics and their order in a report.
STATISTICS = ("count", "mean", "stddev", "min", "max")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def descriptive_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, metric, value): rows, columns, statistics of numbers, distinct values per column.

    A null counts as one value. ``approx`` counts distinct values with a sketch, which saves the
    shuffle of every column's values.
    """
    aggs: list[Column] = [F.count("*").alias("rows")]
    out: list[Column] = [_metric("*", "row_count", F.col("rows")),
                         _metric("*", "column_count", F.lit(len(df.columns)))]
    numeric = set(numeric_columns(df))
    functions = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    for i, name in enumerate(df.columns):
        c = F.col(quoted(name))
        distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        aggs += [distinct.alias(f"d{i}"), F.max(c.isNull().cast("int")).alias(f"n{i}")]
        out.append(_metric(name, "distinct", F.col(f"d{i}") + F.coalesce(F.col(f"n{i}"), F.lit(0))))
        if name in numeric:
            for stat in STATISTICS:
                aggs.append(functions[stat](c).alias(f"{stat}{i}"))
                out.append(_metric(name, stat, F.col(f"{stat}{i}")))
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def profile_report(profile: DataFrame) -> DataFrame:
    """The profile in reading order: totals, then columns by name, statistics in their order."""
    order = ["row_count", "column_count", *STATISTICS, "distinct"]
    return profile.orderBy("column", F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric")))


def column_completeness(df: DataFrame) -> DataFrame:
    """(column, missing_ratio); an empty table gives an empty result."""
    ratios = df.agg(*[
        F.avg(F.col(quoted(c)).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)
    ])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_ratio"))
            for i, c in enumerate(df.columns)]
    return ratios.select(F.inline(F.array(*rows))).filter(F.col("missing_ratio").isNotNull())


def relation_completeness(df: DataFrame) -> DataFrame:
    """One row: the share of rows without any null, 0.0 for an empty table."""
    complete = reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in df.columns], F.lit(True))
    ratio = F.coalesce(F.avg(complete.cast("double")), F.lit(0.0)) if df.columns else F.lit(0.0)
    return df.agg(ratio.alias("complete_ratio"))


def redundancy_ratio(df: DataFrame) -> DataFrame:
    """One row: rows per distinct row (1.0 without duplicates), null for an empty table."""
    groups = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg((F.sum("_n") / F.nullif(F.count("*"), F.lit(0))).alias("redundancy"))


def attribute_timeliness(df: DataFrame, column: str, ts_col: str, update_rate: float = 12,
                         as_of: Column | None = None) -> DataFrame:
    """(attribute, timeliness_score): mean of ``1 / (1 + age_days * update_rate)``."""
    now = F.current_timestamp() if as_of is None else as_of
    age = F.datediff(now, F.col(ts_col)) + F.lit(1e-9)
    score = F.lit(1.0) / (F.lit(1.0) + age * F.lit(float(update_rate)))
    return df.agg(F.lit(column).alias("attribute"), F.avg(score).alias("timeliness_score"))


def _metric(column: str, metric: str, value: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), F.lit(metric).alias("metric"),
                    value.cast("double").alias("value"))
