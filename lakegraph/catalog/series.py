"""Time series: differences, rolling outliers, interpolation, missing dates."""

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from . import query


def events(t):
    """Error events carry no reading; a tenth of the users are not known, and together are one series."""
    reading = F.when(F.col("event_type") != "error", F.col("value"))
    user = F.when(F.col("user_id") % 10 != 3, F.col("user_id"))
    return t.events.select("event_id", user.alias("user_id"), "ts", reading.alias("value"))


# Several ranges even for the smallest tables.
ROWS = 4_000
_EVENTS = """SELECT event_id, CASE WHEN user_id % 10 <> 3 THEN user_id END AS user_id, ts,
  CASE WHEN event_type <> 'error' THEN value END AS value FROM events"""
_MOMENT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"


def _text_time(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _lag_sql(by):
    w = f"OVER ({by} ORDER BY ts, value NULLS FIRST, event_id)"
    return f"""SELECT event_id, {_MOMENT}, value,
  round(coalesce(value - lag(value) {w}, 0), 6) AS increase_value, user_id FROM ({_EVENTS})"""


@query(_lag_sql(""))
def lag_diff(t):
    out = ts.lag_diff(events(t), "value", "ts", tiebreak=["value", "event_id"], rows_per_bucket=ROWS)
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


@query(_lag_sql("PARTITION BY user_id"))
def lag_diff_by_user(t):
    out = ts.lag_diff(events(t), "value", "ts", ["user_id"], ["value", "event_id"], rows_per_bucket=ROWS)
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


def _outlier_sql(columns, by, size=7, k="7.5"):
    p = f"PARTITION BY {by}" if by else ""
    first = f"row_number() OVER (PARTITION BY {by + ', ' if by else ''}ts ORDER BY value NULLS FIRST)"
    w = f"OVER ({p} ORDER BY ts, value NULLS FIRST ROWS {size - 1} PRECEDING)"
    return f"""WITH d AS (SELECT *, coalesce(value - lag(value) OVER ({p} ORDER BY ts, value NULLS FIRST), 0) AS inc,
  {first} AS pos FROM ({_EVENTS})),
q AS (SELECT *, quantile_disc(inc, 0.25) {w} AS q1, quantile_disc(inc, 0.75) {w} AS q3 FROM d)
SELECT {columns}{_MOMENT}, round(inc, 6) AS increase_value, inc > q3 + {k}::DOUBLE * (q3 - q1) AS is_outlier_value
FROM q WHERE pos = 1"""


@query(_outlier_sql("", ""))
def ts_outliers(t):
    out = ts.rolling_iqr_outliers(events(t), "value", "ts", rows_per_bucket=ROWS)
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


@query(_outlier_sql("user_id, ", "user_id"))
def ts_outliers_by_user(t):
    out = ts.rolling_iqr_outliers(events(t), "value", "ts", partition_cols=["user_id"], rows_per_bucket=ROWS)
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


@query(_outlier_sql("", "", 5_000, "1.5"))
def ts_outliers_long(t):
    """A frame of 5,000 rows, longer than a range."""
    out = ts.rolling_iqr_outliers(events(t), "value", "ts", 5_000, 1.5, rows_per_bucket=ROWS)
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


@query(f"""WITH f AS ({_outlier_sql("", "")}) SELECT event_id, f.* FROM (SELECT event_id, {_MOMENT} FROM events) e
LEFT JOIN f USING (ts)""")
def attach_outliers(t):
    flags = ts.rolling_iqr_outliers(events(t), "value", "ts", rows_per_bucket=ROWS)
    out = ts.attach_outlier_flags(events(t).select("event_id", "ts"), flags, "ts")
    return _text_time(out).withColumn("increase_value", F.round("increase_value", 6))


_TWO = "SELECT event_id, user_id, ts, {} AS value FROM (SELECT *, value IS NULL AS gone FROM (" + _EVENTS + "))"


@query(f"""WITH a AS ({_outlier_sql("user_id, ", "user_id")}), b AS (
{_outlier_sql("user_id, ", "user_id").replace(_EVENTS, _TWO.format("(event_id * 7919 % 1000)::DOUBLE"))})
SELECT user_id, ts, a.is_outlier_value AS is_outlier_value, b.is_outlier_value AS is_outlier_code
FROM a JOIN b ON a.ts = b.ts AND a.user_id IS NOT DISTINCT FROM b.user_id""".replace("SELECT user_id, ts, a.is", "SELECT a.user_id, a.ts, a.is"))
def outliers_of_columns(t):
    """Readings and a code, each judged in its own order of values, in one pass."""
    both = events(t).withColumn("code", (F.col("event_id") * 7919 % 1000).cast("double"))
    return _text_time(ts.outliers_of_columns(both, ["value", "code"], "ts", partition_cols=["user_id"], rows_per_bucket=ROWS))


def _fill_sql(by, fallback, latest=False):
    p = f"PARTITION BY {by}" if by else ""
    order = f"OVER ({p} ORDER BY ts, event_id ROWS BETWEEN"
    nxt = f"first_value(value IGNORE NULLS) {order} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    last = f"last_value(value IGNORE NULLS) {order} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    after = f"CASE WHEN {nxt} IS NOT NULL THEN {last} END" if latest else nxt
    return f"""WITH n AS (SELECT *, last_value(value IGNORE NULLS) {order} UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  {after} AS n FROM ({_EVENTS}))
SELECT event_id, user_id, {_MOMENT}, round(coalesce(value, (p + n) / 2, p, n{fallback}), 6) AS value FROM n"""


def _filled(df):
    return _text_time(df).withColumn("value", F.round("value", 6))


@query(_fill_sql("", ""))
def interpolate(t):
    return _filled(ts.interpolate_missing(events(t), "ts", ["value"], tiebreak=["event_id"], rows_per_bucket=ROWS))


@query(_fill_sql("user_id", ""))
def interpolate_by_user(t):
    return _filled(ts.interpolate_missing(events(t), "ts", ["value"], ["user_id"], ["event_id"], ROWS))


@query(_fill_sql("", ", 0"))
def interpolate_zero(t):
    return _filled(ts.interpolate_impute(events(t), ["value"], "ts", tiebreak=["event_id"], rows_per_bucket=ROWS))


@query(_fill_sql("", ", 0", latest=True))
def interpolate_latest(t):
    return _filled(ts.interpolate_impute(events(t), ["value"], "ts", "latest", tiebreak=["event_id"], rows_per_bucket=ROWS))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
c AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day)
SELECT day::VARCHAR AS date FROM c WHERE day NOT IN (SELECT day FROM d)""")
def missing_dates(t):
    """Days on which no urgent order was pending."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return ts.check_missing_dates(urgent, "o_orderdate").missing.select(F.col("date").cast("string").alias("date"))
