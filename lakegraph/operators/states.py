"""Profiles that add up: what a load says about its columns is kept as a small state, and states are merged.

A state holds counts, means with their squared deviations, extremes, and two sketches (distinct values,
quantiles). The profile of all loads comes from their states alone, so a load is read once, when it
arrives, and old loads are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import quoted
from .profile import numeric_columns

# Sketch sizes: distinct values within about 1.6 % (one standard error at 2^12 registers), quantiles within
# about 1.3 % of the ranks.
DISTINCT_BITS, QUANTILE_SIZE = 12, 200
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03


def profile_states(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per column of ``df`` (and per load, if ``by`` names it), in one pass: its state.

    An empty table has states that count nothing.
    """
    numeric, aggs, rows = set(numeric_columns(df)), [F.count("*").alias("rows")], []
    for i, name in enumerate(c for c in df.columns if c not in by):
        c = F.col(quoted(name))
        text = c.cast("string") if not _nested(df, name) else F.to_json(F.struct(c))
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(text, DISTINCT_BITS).alias(f"d{i}")]
        number = c.cast("double") if name in numeric else F.lit(None).cast("double")
        if name in numeric:
            aggs += [F.avg(number).alias(f"m{i}"), (F.var_pop(number) * F.count(number)).alias(f"s{i}"), F.min(number).alias(f"lo{i}"),
                     F.max(number).alias(f"hi{i}"), F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias(f"q{i}")]
        own = lambda x, kind, i=i, name=name: F.col(f"{x}{i}") if name in numeric else F.lit(None).cast(kind)
        rows.append(F.struct(
            F.lit(name).alias("column"), F.col("rows"), F.col(f"n{i}").alias("filled"), F.lit(name in numeric).alias("is_number"),
            own("m", "double").alias("mean"), own("s", "double").alias("squares"), own("lo", "double").alias("low"),
            own("hi", "double").alias("high"), F.col(f"d{i}").alias("distinct"), own("q", "binary").alias("quantiles")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def _nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString().startswith(("array", "map", "struct", "variant"))


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """States of several loads as one per column (and ``by``), of the same form, so that merging can go on.

    Deviations are taken from the common mean, which stays exact where sums of squares would cancel out.
    """
    keys = [*by, "column"]
    w = Window.partitionBy(*keys)
    n = F.when(F.col("mean").isNotNull(), F.col("filled"))
    common = F.sum(n * F.col("mean")).over(w) / F.sum(n).over(w)
    shifted = states.withColumn("_mean", common).withColumn(
        "_squares", F.col("squares") + n * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    return shifted.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.bool_or("is_number").alias("is_number"),
        F.max("_mean").alias("mean"), F.sum("_squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("quantiles"))


def states_report(states: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, metric, value) of merged states: row count, missing ratio, distinct values (a null counts as one),
    and for numbers count, mean, stddev, min, max and quantiles (``q`` and the share in percent).

    Distinct values and quantiles are estimates; everything else is what one pass over all rows gives.
    """
    entry = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    some = F.col("filled") > 0
    plain = [entry("row_count", F.col("rows")), entry("missing_ratio", 1 - F.col("filled") / F.nullif(F.col("rows"), F.lit(0))),
             entry("distinct", F.hll_sketch_estimate("distinct") + (F.col("filled") < F.col("rows")).cast("long"))]
    numbers = [entry("count", F.col("filled")), entry("mean", F.col("mean")),
               entry("stddev", F.sqrt(F.col("squares") / F.nullif(F.col("filled") - 1, F.lit(0)))), entry("min", F.col("low")), entry("max", F.col("high"))]
    numbers += [entry(f"q{round(100 * p)}", F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))) for p in shares]
    metrics = F.concat(F.array(*plain), F.when(F.col("is_number"), F.array(*numbers)).otherwise(F.array().cast("array<struct<metric:string,value:double>>")))
    return states.select("column", F.inline(metrics))
