"""Cutting an ordered table into key ranges, so that ordered work never lands in one task.

The table is written once, then dealt by ``repartitionByRange`` over the full ordering key (series,
time, tie-break, row hash) and written again with its partition number as a column. That column is the
range from then on. So a series that holds a third of the rows is spread over many ranges, a series of
ten rows stays in one, and the code is the same at every size: a small table just has one range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import work_path

BUCKET = "_bucket"
ROWS_PER_BUCKET = 50_000
# A row that stands for more copies than this is made again in pieces of so many, in several tasks.
COPIES_AT_ONCE = 100_000


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_ranges(df: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df``, a stored table, with its range of ``keys`` as ``_bucket``; ranges are numbered in key order.

    A range has about ``rows_per_bucket`` rows, or the square root of the table's if that is more: then
    neither a range nor the summaries with a row per range outgrow one task.
    """
    n = df.count()
    size = max(rows_per_bucket, math.isqrt(n))
    ranges = df.repartitionByRange(max(1, math.ceil(n / size)), *keys).withColumn(BUCKET, F.spark_partition_id())
    return stored(ranges, "ranges")


def collapse_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with their number as ``_copies``, so that no key value can fill more than a range."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    keys = [F.array_sort(F.map_entries(c)).alias(f"_e_{c}") if c in maps else F.col(c) for c in df.columns]
    out = df.groupBy(*keys).agg(F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in maps])
    return out.select(*df.columns, "_copies")


def expand_copies(df: DataFrame, most: int, name: str = "_i") -> DataFrame:
    """One row per copy again, numbered from 1 as ``_i``. ``most`` is the largest number of copies."""
    if most > COPIES_AT_ONCE:
        pieces = F.ceil(F.col("_copies") / COPIES_AT_ONCE).cast("long")
        df = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
        df = df.repartition(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    else:
        df = df.withColumn("_piece", F.lit(0).cast("long"))
    first = F.col("_piece") * COPIES_AT_ONCE + 1
    last = F.least(F.col("_copies"), first + COPIES_AT_ONCE - 1)
    return df.withColumn(name, F.explode(F.sequence(first, last))).drop("_piece")


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of columns in which null equals null, as for the windows."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def crossing(ranges: DataFrame, series: list[str]) -> DataFrame:
    """The series that lie in more than one range: at most one for each border."""
    return ranges.groupBy(*series).agg(F.min(BUCKET).alias("_lo"), F.max(BUCKET).alias("_hi")).filter("_lo < _hi").select(*series)


def of_crossing(df: DataFrame, ranges: DataFrame, series: list[str]) -> DataFrame:
    """Rows of ``df`` whose series crosses a border; all rows if there are no series."""
    if not series:
        return df
    over = stored(crossing(ranges, series), "crossing")
    return df.join(over, same(df, over, series), "left_semi")


def time_key(df: DataFrame, col: str) -> Column:
    """A time column as a long (micros for timestamps, days for dates); other types unchanged."""
    t = df.schema[col].dataType
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(t, T.TimestampType):
        return F.unix_micros(F.col(col))
    if isinstance(t, T.DateType):
        return F.unix_date(F.col(col))
    return F.col(col)


def with_halo(ranges: DataFrame, series: list[str], order: list[str], rows: int) -> DataFrame:
    """Add to each range the ``rows`` rows that precede it, marked ``_halo``.

    Only series that cross a border have any. The tail of a range is found with a grouped top-k that
    Spark already applies before the shuffle; each tail row then looks at the next ``rows`` tail rows of
    its series to see which later ranges need it. Per series that is at most ``rows`` for each range.
    """
    last = Window.partitionBy(*series, BUCKET).orderBy(*[F.desc(c) for c in order])
    tails = of_crossing(ranges, ranges, series)
    tails = tails.withColumn("_pos", F.row_number().over(last)).filter(F.col("_pos") <= rows).drop("_pos")
    ahead = Window.partitionBy(*(series or [F.lit(0)])).orderBy(*order)
    end = F.max(BUCKET).over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Ranges are numbered in order, so the range of the last row in reach is the last that needs this one.
    halo = (
        tails.withColumn("_last", F.coalesce(F.lead(BUCKET, rows).over(ahead), end)).filter(F.col("_last") > F.col(BUCKET))
        .withColumn(BUCKET, F.explode(F.sequence(F.col(BUCKET) + 1, "_last"))).drop("_last")
        .withColumn("_halo", F.lit(True))
    )
    return ranges.withColumn("_halo", F.lit(False)).unionByName(halo)


def before_ranges(ranges: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``_bucket`` and, per name, the sum over all earlier ranges: one row per range."""
    each = ranges.groupBy(BUCKET).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(BUCKET, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def global_row_number(df: DataFrame, order: list[str], name: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                      weight: str | None = None) -> DataFrame:
    """``row_number`` over the whole table (or a running sum of ``weight``), range by range.

    ``df`` is written once. ``order`` should tell rows apart; rows that agree on it share a range.
    """
    ranges = cut_ranges(stored(df, "to-number"), order, rows_per_bucket)
    step = F.col(weight) if weight else F.lit(1)
    inside = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranges.withColumn(name, F.sum(step).over(inside).cast("bigint"))
    before = stored(before_ranges(ranges, {"_before": step}), "before")
    return numbered.join(before, BUCKET).withColumn(name, F.col(name) + F.col("_before").cast("bigint")).drop(BUCKET, "_before")


def exact_quantiles(df: DataFrame, col: str, probabilities: list[float],
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> list:
    """Exact quantiles (the element at rank ``ceil(p*n)``) without gathering the column anywhere.

    Two passes over the table. A bounded sketch brackets each quantile to within half a percent
    of the ranks; then values inside a bracket are counted one by one and all others only by
    their side of the brackets. That small table is written once, cut into ranges, and each rank is
    found inside its range. Returns one value per probability, ``[]`` for no values.
    """
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("_v"))
    if isinstance(values.schema["_v"].dataType, (T.FloatType, T.DoubleType)):
        values = values.filter(~F.isnan("_v"))
    asked = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-_BRACKET, _BRACKET)]
    edges = values.approxQuantile("_v", asked, _BRACKET / 2)
    if not edges:
        return []
    brackets = list(zip(edges[::2], edges[1::2]))
    inside = [F.col("_v").between(lo, hi) for lo, hi in brackets]
    below = [(F.col("_v") < lo).alias(f"_b{i}") for i, (lo, _) in enumerate(brackets)]
    cells = stored(values.groupBy(F.when(reduce(lambda a, b: a | b, inside), F.col("_v")).alias("_v"), *below)
                   .agg(F.count("*").alias("_n")), "quantiles")
    total, *under = cells.agg(F.sum("_n"), *[
        F.coalesce(F.sum(F.when(F.col(f"_b{i}"), F.col("_n"))), F.lit(0)) for i in range(len(brackets))]).first()
    ranks = [max(1, math.ceil(p * total - 1e-9)) - under[i] for i, p in enumerate(probabilities)]
    ranges = cut_ranges(cells.filter("_v IS NOT NULL"), ["_v"], rows_per_bucket)
    counted = {f"_c{i}": F.when(here, F.col("_n")).otherwise(0) for i, here in enumerate(inside)}
    running = Window.partitionBy(BUCKET).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    before = stored(before_ranges(ranges, counted), "before").withColumnsRenamed({n: f"{n}_before" for n in counted})
    reached = ranges.withColumns({n: F.sum(c).over(running) for n, c in counted.items()}).join(before, BUCKET)
    return list(reached.agg(*[
        F.min(F.when(here & (F.col(f"_c{i}") + F.col(f"_c{i}_before") >= rank), F.col("_v"))).alias(f"q{i}")
        for i, (here, rank) in enumerate(zip(inside, ranks))]).first())


_BRACKET = 0.002
