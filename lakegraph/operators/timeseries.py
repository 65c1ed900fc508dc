"""Time-series operators over ordered rows, with or without series columns.

Every ordered pass runs inside key ranges (see ``ordering``), whatever the size of the table. Copies of
a row are one row with a count until the end. Row frames get the few rows that precede a range as a
halo; open-ended frames get the nearest value outside the range from a summary with one row per range
of the series that cross a border. Results equal those of one window over the whole table, null series
keys included. Ties on the time column follow ``tiebreak``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .ordering import (BUCKET, ROWS_PER_BUCKET, collapse_copies, cut_ranges, expand_copies, of_crossing, same, stored,
                       time_key, with_halo)
from .profile import numeric_columns
from .sliding import frame_elements

# Rows of a frame that are collected and sorted for every row.
SHORT_FRAME = 64


def lag_diff(df: DataFrame, col: str, ts: str, partition_cols=(), tiebreak=(), name: str | None = None,
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Increase over the previous row in time, 0 for the first row and where it is unknown."""
    series, name = list(partition_cols), name or f"increase_{col}"
    keyed, order = _ordered(df, ts, [*(tiebreak or [col]), _row_hash(df)])
    rows = stored(collapse_copies(keyed), "rows")
    ranges = cut_ranges(rows, series + order, rows_per_bucket)
    w = Window.partitionBy(*series, BUCKET).orderBy(*order)
    diff = F.coalesce(F.col(col) - F.lag(col, 1).over(w), _zero(df, col))
    out = with_halo(ranges, series, order, 1).withColumn(name, diff).filter(~F.col("_halo"))
    # Copies of a row follow each other, so only the first one can differ from its predecessor.
    out = expand_copies(out, _most(rows))
    return out.withColumn(name, F.when(F.col("_i") == 1, F.col(name)).otherwise(_zero(df, col))).select(*df.columns, name)


def rolling_iqr_outliers(df: DataFrame, col: str, ts: str, window_size: int = 7, k: float = 7.5,
                         partition_cols=(), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per series and time: increase, and whether it exceeds Q3 + k * IQR.

    Quartiles are taken over the increases of the last ``window_size`` rows, the row itself
    included (the element at rank ``ceil(q * n)``). Of rows with one time the first by value stays.
    A frame of at most ``SHORT_FRAME`` rows is sorted for each row in compiled code; a longer one slides over
    a range in sorted blocks, so that a row costs little more however long the frame is.
    """
    series = list(partition_cols)
    increase, flag = f"increase_{col}", f"is_outlier_{col}"
    rows = df.select(*series, ts, F.col(col).alias("_v"))
    rows, order = _ordered(rows, ts, ["_v"])
    # More copies than a frame can see change nothing: the first one gives the result row,
    # the last ``window_size`` are all that later frames reach.
    copies = F.sequence(F.lit(1), F.least(F.col("_copies"), F.lit(window_size + 1)).cast("int"))
    rows = collapse_copies(rows).withColumn("_copy", F.explode(copies)).drop("_copies")
    order = order + ["_copy"]
    ranges = cut_ranges(stored(rows, "rows"), series + order, rows_per_bucket)
    w = Window.partitionBy(*series, BUCKET).orderBy(*order)
    diff = F.coalesce(F.col("_v") - F.lag("_v", 1).over(w), _zero(df, col))
    is_first = (F.row_number().over(w) == 1) | ~F.lag("_t", 1).over(w).eqNullSafe(F.col("_t"))
    rows = with_halo(ranges, series, order, window_size).withColumns({increase: diff, "_first": is_first})
    if window_size <= SHORT_FRAME:
        frame = F.array_sort(F.collect_list(increase).over(w.rowsBetween(-(window_size - 1), 0)))
        rows = rows.withColumn("_frame", frame).filter(~F.col("_halo") & F.col("_first")).withColumns(
            {"_q1": _disc(F.col("_frame"), 0.25), "_q3": _disc(F.col("_frame"), 0.75)})
    else:
        rows = _sliding_quartiles(rows, increase, w, series, ts, window_size)
    return rows.select(*series, ts, increase,
                       (F.col(increase) > F.col("_q3") + F.lit(k) * (F.col("_q3") - F.col("_q1"))).alias(flag))


def _sliding_quartiles(rows: DataFrame, increase: str, w, series: list[str], ts: str, window_size: int) -> DataFrame:
    """Rows that are first of their time with ``_q1`` and ``_q3`` of their frames; one group per range and series."""
    keys = [f"_s{i}" for i in range(len(series))]
    numbered = rows.withColumn("_n", F.row_number().over(w)).select(
        BUCKET, *[F.col(c).alias(k) for c, k in zip(series, keys)], F.col(ts).alias("_ts"), F.col(increase).alias("_x"), "_n",
        (~F.col("_halo") & F.col("_first")).alias("_asked"))
    kept = [*keys, "_ts", "_x"]
    schema = T.StructType([numbered.schema[c] for c in kept] + [T.StructField(q, numbered.schema["_x"].dataType) for q in ("_q1", "_q3")])

    def quartiles(group: pa.Table) -> pa.Table:
        group = group.sort_by("_n")
        kind = group.schema.field("_x").type
        found = [pa.array(q, kind) for q in frame_elements(group["_x"].to_pylist(), window_size, (0.25, 0.75))]
        group = group.select([*kept, "_asked"]).append_column("_q1", found[0]).append_column("_q3", found[1])
        return group.filter(group["_asked"]).select([*kept, "_q1", "_q3"])

    out = numbered.groupBy(BUCKET, *keys).applyInArrow(quartiles, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(series, keys)], F.col("_ts").alias(ts), F.col("_x").alias(increase), "_q1", "_q3")


def outliers_of_columns(df: DataFrame, cols: list[str], ts: str, window_size: int = 7, k: float = 7.5,
                        partition_cols=(), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rolling_iqr_outliers`` of several columns in one pass: a flag per column, by series and time.

    The columns are stacked and their names are one more series column, so there is one set of ranges.
    """
    series = list(partition_cols)
    stacked = df.select(*series, ts, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in cols])))
    flags = rolling_iqr_outliers(stacked, "_value", ts, window_size, k, ["_column", *series], rows_per_bucket)
    return flags.groupBy(*series, ts).agg(*[
        F.max(F.when(F.col("_column") == c, F.col("is_outlier__value"))).alias(f"is_outlier_{c}") for c in cols])


def attach_outlier_flags(df: DataFrame, flags: DataFrame, ts: str, partition_cols=()) -> DataFrame:
    """Add the flag columns to every row by series and time, left outer; null keys meet null keys."""
    keys = [*partition_cols, ts]
    named = flags.withColumnsRenamed({c: f"_flag_{c}" for c in keys})
    on = [df[c].eqNullSafe(named[f"_flag_{c}"]) for c in keys]
    return df.join(named, on, "left").drop(*[f"_flag_{c}" for c in keys])


def interpolate_missing(df: DataFrame, ts: str, cols: list[str] | None = None, partition_cols=(), tiebreak=(),
                        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Null numbers become the mean of the nearest known values before and after.

    One side only: that side. None: null. Filled columns are doubles.
    """
    return _fill(df, ts, cols, partition_cols, tiebreak, rows_per_bucket, None, "adjacent")


def interpolate_impute(df: DataFrame, cols: list[str], ts: str, next_value: str = "adjacent", partition_cols=(),
                       tiebreak=(), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """As ``interpolate_missing`` for the named columns, with 0 where nothing is known.

    ``next_value="latest"`` takes the last known value of the series in place of the adjacent
    one, wherever a later value exists.
    """
    if next_value not in ("adjacent", "latest"):
        raise ValueError(f"next_value is {next_value!r}; it must be one of: adjacent, latest")
    return _fill(df, ts, cols, partition_cols, tiebreak, rows_per_bucket, 0.0, next_value)


@dataclass(frozen=True)
class MissingDates:
    """Dates of the calendar between the first and last date, and those without a row."""

    missing: DataFrame
    all_dates: DataFrame

    def is_complete(self) -> bool:
        return self.missing.isEmpty()


def check_missing_dates(df: DataFrame, col: str) -> MissingDates:
    """Calendar days between the first and the last date that no row has. No dates: nothing missing."""
    day = F.to_date(F.col(col))
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    all_dates = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    present = df.select(day.alias("date")).distinct()
    return MissingDates(all_dates.join(present, "date", "left_anti"), all_dates)


def _fill(df, ts, cols, partition_cols, tiebreak, rows_per_bucket, fallback, next_value):
    series = list(partition_cols)
    cols = cols or [c for c in numeric_columns(df) if c != ts and c not in series]
    keyed, order = _ordered(df, ts, [*tiebreak, _row_hash(df)])
    # Copies of a row get the same value, so one of them stands for all until the end.
    rows = stored(collapse_copies(keyed), "rows")
    ranges = cut_ranges(rows, series + order, rows_per_bucket)
    w = Window.partitionBy(*series, BUCKET).orderBy(*order)
    # "After" is "before" in reverse order: a growing frame costs one step per row, whereas a
    # shrinking one would be read anew for every row.
    back = Window.partitionBy(*series, BUCKET).orderBy(*[F.desc(c) for c in order])
    before, after = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, back))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {}
    for i, c in enumerate(cols):
        near[f"_p{i}"] = F.last(c, ignorenulls=True).over(before)
        near[f"_n{i}"] = F.last(c, ignorenulls=True).over(after)
        near[f"_l{i}"] = F.last(c, ignorenulls=True).over(whole)
    carry = _carry(ranges, series, order, cols)
    out = ranges.withColumns(near)
    out = out.join(carry, same(out, carry, [*series, BUCKET]), "left").drop(*[carry[c] for c in [*series, BUCKET]])
    out = out.withColumns({f"_{x}{i}": F.coalesce(*parts) for i in range(len(cols)) for x, parts in (
        ("p", (f"_p{i}", f"_cp{i}")), ("n", (f"_n{i}", f"_cn{i}")), ("l", (f"_cl{i}", f"_l{i}")))})
    out = expand_copies(out, _most(rows))
    at = {c: i for i, c in enumerate(cols)}
    return out.select(*[_filled(c, at[c], fallback, next_value).alias(c) if c in at else F.col(c) for c in df.columns])


def _filled(c, i, fallback, next_value):
    prev, nxt = F.col(f"_p{i}").cast("double"), F.col(f"_n{i}").cast("double")
    if next_value == "latest":
        nxt = F.when(nxt.isNotNull(), F.col(f"_l{i}").cast("double"))
    last_resort = [] if fallback is None else [F.lit(fallback)]
    return F.coalesce(F.col(c).cast("double"), (prev + nxt) / 2, prev, nxt, *last_resort)


def _carry(ranges, series, order, cols):
    """Per range of a series that crosses a border: nearest known values outside it, and the series' last."""
    key = F.struct(*order)
    known = {c: F.when(F.col(c).isNotNull(), key) for c in cols}
    aggs = [a for i, c in enumerate(cols) for a in (
        F.min_by(c, known[c]).alias(f"_f{i}"), F.max_by(c, known[c]).alias(f"_e{i}"))]
    summary = of_crossing(ranges, ranges, series).groupBy(*series, BUCKET).agg(*aggs)
    w = Window.partitionBy(*(series or [F.lit(0)])).orderBy(BUCKET)
    back = Window.partitionBy(*(series or [F.lit(0)])).orderBy(F.desc(BUCKET))
    before, after = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, back))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = summary.select(*series, BUCKET, *[x for i in range(len(cols)) for x in (
        F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_cp{i}"),
        F.last(f"_f{i}", ignorenulls=True).over(after).alias(f"_cn{i}"),
        F.last(f"_e{i}", ignorenulls=True).over(whole).alias(f"_cl{i}"))])
    return stored(carry, "carry")


def _ordered(df: DataFrame, ts: str, tiebreak) -> tuple[DataFrame, list[str]]:
    """The table with its ordering columns ``_t`` and ``_k0..`` added."""
    ties = [t if isinstance(t, Column) else time_key(df, t) for t in tiebreak]
    named = {"_t": time_key(df, ts), **{f"_k{i}": t for i, t in enumerate(ties)}}
    return df.withColumns(named), list(named)


def _row_hash(df: DataFrame) -> Column:
    """Last tie-break, so that a crowded time is spread over ranges unless its rows are copies."""
    return F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def _most(rows: DataFrame) -> int:
    return rows.agg(F.max("_copies")).first()[0] or 0


def _zero(df: DataFrame, col: str) -> Column:
    return F.lit(0).cast(df.schema[col].dataType)


def _disc(values: Column, q: float) -> Column:
    return F.element_at(values, F.ceil(F.lit(q) * F.size(values)).cast("int"))
