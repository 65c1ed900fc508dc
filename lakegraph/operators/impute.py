"""Filling missing values with a median, a mean or the most frequent value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, string_columns
from .ordering import exact_quantiles

# The column types filled when none are named, and the fill of an all-null text column.
NUMERIC_DTYPES = ("int", "bigint", "double", "float")
UNKNOWN = "unknown"


def impute_numerical(df: DataFrame, cols: list[str] | None = None, strategy: str = "median",
                     default_fill: float = 0.0, rel_error: float = 0.01) -> DataFrame:
    """Nulls replaced by the column's median or mean, ``default_fill`` where it has no values.

    All fills come from one aggregate, read as a scalar subquery. Filled columns are doubles.
    ``rel_error=0`` asks for exact medians, which costs a few small jobs per column.
    """
    if strategy not in ("median", "mean"):
        raise ValueError(f"cannot impute by {strategy!r}; known ways: mean, median")
    if cols is None:
        cols = [c for c, dtype in df.dtypes if dtype in NUMERIC_DTYPES]
    if not cols:
        return df
    if strategy == "median" and rel_error == 0:
        found = {c: exact_quantiles(df.select(F.col(quoted(c)).alias("v")), "v", [0.5]) for c in cols}
        fill = {c: F.lit(float(q[0])) if q else F.lit(None).cast("double") for c, q in found.items()}
    else:
        accuracy = int(1 / rel_error) if rel_error else 0
        stat = F.avg if strategy == "mean" else lambda c: F.percentile_approx(c, 0.5, accuracy)
        fills = df.agg(F.struct(*[
            stat(F.col(quoted(c))).cast("double").alias(f"f{i}") for i, c in enumerate(cols)
        ])).scalar()
        fill = {c: fills[f"f{i}"] for i, c in enumerate(cols)}
    return df.select(*[
        F.coalesce(F.col(quoted(c)).cast("double"), fill[c], F.lit(float(default_fill))).alias(c)
        if c in fill else F.col(quoted(c)) for c in df.columns
    ])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(quoted(col)).alias("value")).agg(F.count("*").alias("count"))


def mode(df: DataFrame, col: str) -> DataFrame:
    """One row (value, count): the most frequent value, the smallest one among equals."""
    best = value_counts(df, col).agg(F.min(_frequency_first("value", "count")).alias("m"))
    return best.filter("m IS NOT NULL").select(F.col("m.value").alias("value"), (-F.col("m.neg")).alias("count"))


def rank_values(df: DataFrame, col: str) -> DataFrame:
    """Every value of rank 1 by frequency (ties stay), without ordering all values in one task."""
    counts = value_counts(df, col)
    return counts.filter(F.col("count") == counts.agg(F.max("count")).scalar())


def impute_with_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls of text columns replaced by the mode; ``unknown`` where nulls are the most frequent.

    All columns are counted in one grouped job, partially aggregated on both levels, so neither
    a hot value nor a column with many values gathers in one task.
    """
    cols = string_columns(df) if cols is None else cols
    if not cols:
        return df
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(quoted(c)).alias("value")) for i, c in enumerate(cols)])
    best = (
        df.select(F.inline(cells)).groupBy("col", "value").agg(F.count("*").alias("count"))
        .groupBy("col").agg(F.min(_frequency_first("value", "count")).alias("m"))
    )
    modes = best.agg(F.map_from_entries(F.collect_list(F.struct("col", "m.value")))).scalar()
    at = {c: i for i, c in enumerate(cols)}
    return df.select(*[
        F.coalesce(F.col(quoted(c)), F.try_element_at(modes, F.lit(at[c])), F.lit(UNKNOWN)).alias(c)
        if c in at else F.col(quoted(c)) for c in df.columns
    ])


def _frequency_first(value: str, count: str):
    """Orders by count descending, real values before null, then by value."""
    return F.struct((-F.col(count)).alias("neg"), F.col(value).isNull().alias("missing"), F.col(value).alias("value"))
