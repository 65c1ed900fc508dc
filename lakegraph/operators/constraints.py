"""Declarative row constraints and percentile trimming."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles


@dataclass(frozen=True)
class Rule:
    """A named condition; a row stays only where it is true (null counts as a failure)."""

    name: str
    condition: Column


def apply_constraints(df: DataFrame, rules: list[Rule], drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that satisfy every rule, without the redundant columns in ``drop``.

    One conjunction, so Catalyst can push the parts that a Parquet scan understands.
    """
    if rules:
        df = df.filter(reduce(lambda a, b: a & b, [r.condition for r in rules]))
    return df.drop(*drop)


def rejected_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, rejected): how many rows each rule would drop, all rules in one pass."""
    failed = [F.count_if(~F.coalesce(r.condition, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("rejected"))
                     for i, r in enumerate(rules)])
    return df.agg(*failed).select(F.inline(rows))


def between(col: Column, lo, hi) -> Column:
    return (col >= lo) & (col <= hi)


def null_or(col: Column, condition: Column) -> Column:
    return col.isNull() | condition


def array_all(col: Column, predicate) -> Column:
    """Every element passes; an empty array passes, a null array gives null."""
    return (F.size(col) == 0) | F.forall(col, predicate)


def null_ratio(df: DataFrame, col: str) -> float:
    return df.agg(F.avg(F.col(col).isNull().cast("double"))).first()[0] or 0.0


def trim_percentiles(df: DataFrame, col: str, lo: float = 0.05, hi: float = 0.95, max_null_ratio: float = 0.1,
                     null_ratio_before: float | None = None, rel_error: float = 0.01) -> DataFrame:
    """Keep ``p_lo <= x <= p_hi``, but only where few enough values are missing.

    ``null_ratio_before`` is the share measured before any constraint ran; by default it is
    measured on ``df``. ``rel_error=0`` finds the exact percentiles by ranges, without
    gathering the column; otherwise the bounded quantile sketch is used. No values: no change.
    """
    ratio = null_ratio(df, col) if null_ratio_before is None else null_ratio_before
    if ratio > max_null_ratio:
        return df
    found = exact_quantiles(df, col, [lo, hi]) if rel_error == 0 else df.approxQuantile(col, [lo, hi], rel_error)
    if not found:
        return df
    return df.filter(between(F.col(col), F.lit(found[0]), F.lit(found[1])))
