"""Typed values: casts that give null instead of an error, codes, times, nested fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_cast(col: Column, to: str) -> Column:
    """The typed value of a text, null where it has none.

    Text that cannot be a whole number is turned away by a pattern first, because a failing cast
    costs many times more than a successful one.
    """
    if to in ("int", "integer", "bigint", "long", "smallint", "tinyint"):
        return F.when(col.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), col.try_cast(to))
    return col.try_cast(to)


def flag_to_boolean(col: Column) -> Column:
    return col == 1


def epoch_to_timestamp(col: Column) -> Column:
    """Epoch seconds, as text or number, to a timestamp; anything else gives null."""
    return F.timestamp_seconds(safe_cast(col, "bigint"))


def format_timestamp(col: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.to_timestamp(col), fmt)


def map_codes(col: Column, mapping: dict) -> Column:
    """The label of a code; a code that is not in ``mapping`` gives null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


def coalesce_id(mapped: Column, fallback: Column) -> Column:
    """The mapped identifier, or the source's own one as text."""
    return F.coalesce(mapped, fallback.cast("string"))


def decade_of(col: Column) -> Column:
    return F.floor(col / 10) * 10


def project_nested(col: Column, *fields: str) -> Column:
    """Keep some fields of each element of a list of records; missing records are dropped."""
    return F.transform(
        F.filter(col, lambda x: x.isNotNull()),
        lambda x: F.struct(*[x[f].alias(f) for f in fields]),
    )


def flatten_struct(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Pull nested fields up: ``{new name: dotted path}``, in order."""
    return df.select(*[F.col(path).alias(name) for name, path in paths.items()])


def explode_list(df: DataFrame, col: str, alias: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per element; a null or empty list drops the row unless ``keep_empty``."""
    explode = F.explode_outer if keep_empty else F.explode
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, explode(F.col(col)).alias(alias or col))


def select_columns(df: DataFrame, order: list[str], drop_if_present: tuple[str, ...] = ()) -> DataFrame:
    """Named columns first in this order, without the redundant ones that happen to exist."""
    return df.select(*order).drop(*drop_if_present)
