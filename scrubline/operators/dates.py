"""Date transforms on timestamps without time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import (
    is_numeric, is_text, is_time, named, order_columns, require_batch, require_columns, type_of,
)
from scrubline.functions import dates

PARTS = ("year", "month", "day", "weekday", "quarter")
OFFSET_UNITS = ("days", "weeks", "months", "years")
DIFFERENCE_UNITS = ("days", "weeks", "hours", "years")


def fit_format(df: DataFrame, column: str, order_by: str | None = None) -> dict:
    """The format of the first value in row order, None when it is no date."""
    require_columns(df, [column])
    if not is_text(df, column):
        return {"format": None}
    require_batch(df, "guessing a date format")
    order = order_columns(df, order_by)
    first = (
        df.where(named(column).isNotNull())
        .select(F.min_by(named(column), F.struct(*[named(o) for o in order])).alias("v"))
        .first()
    )
    return {"format": dates.guess_format(first["v"]) if first["v"] is not None else None}


def moments_of(
    df: DataFrame,
    column: str,
    format: str | None = None,
    order_by: str | None = None,
    stats: dict | None = None,
) -> Column:
    """The column as timestamp without time zone, unparseable values null.

    Text without a given format is read by the format of its first value; if
    that is no date, every value is read on its own.
    """
    require_columns(df, [column])
    if is_time(df, column):
        return named(column).cast("timestamp_ntz")
    if is_text(df, column):
        fmt = format or (stats if stats is not None else fit_format(df, column, order_by))["format"]
        return dates.parse_format(named(column), fmt) if fmt else dates.parse_each(named(column))
    if is_numeric(df, column) and not isinstance(type_of(df, column), T.DecimalType):
        # a bare number counts nanoseconds from 1970, as it would unparsed
        return dates.from_epoch_micros(F.floor(named(column) / 1000))
    return F.lit(None).cast("timestamp_ntz")


def convert_to_datetime(
    df: DataFrame,
    column: str,
    format: str | None = None,
    order_by: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    return df.withColumn(column, moments_of(df, column, format, order_by, stats))


def extract_date_part(
    df: DataFrame,
    column: str,
    part: str,
    new_column: str | None = None,
    order_by: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    if part not in PARTS:
        raise ValueError(f"a date has no {part!r}; parts are {', '.join(PARTS)}")
    moment = moments_of(df, column, None, order_by, stats)
    result = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "weekday": lambda m: F.date_format(m, "EEEE"),
        "quarter": F.quarter,
    }[part](moment)
    return df.withColumn(new_column or column, result)


def offset_date(
    df: DataFrame,
    column: str,
    value: int,
    unit: str,
    new_column: str | None = None,
    order_by: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Shift by days, weeks, months or years; month ends clamp, the time stays.

    The source column itself also becomes a timestamp.
    """
    if unit not in OFFSET_UNITS:
        raise ValueError(f"dates cannot be moved by {unit!r}; units are {', '.join(OFFSET_UNITS)}")
    df = df.withColumn(column, moments_of(df, column, None, order_by, stats))
    zero = F.lit(0)
    step = {
        "days": lambda: F.make_dt_interval(F.lit(value)),
        "weeks": lambda: F.make_dt_interval(F.lit(7 * value)),
        "months": lambda: F.make_ym_interval(zero, F.lit(value)),
        "years": lambda: F.make_ym_interval(F.lit(value), zero),
    }[unit]()
    return df.withColumn(new_column or column, named(column) + step)


def date_difference(
    df: DataFrame,
    column: str,
    reference_date: str = "today",
    unit: str = "days",
    new_column: str | None = None,
    order_by: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Time from each value to one reference moment, fixed when called."""
    if unit not in DIFFERENCE_UNITS:
        raise ValueError(f"time is not measured in {unit!r}; units are {', '.join(DIFFERENCE_UNITS)}")
    if reference_date in ("today", "now"):
        reference = datetime.now()
    else:
        fmt = dates.guess_format(reference_date)
        if fmt is None:
            raise ValueError(f"unreadable reference date {reference_date!r}")
        reference = datetime.strptime(reference_date, fmt)
    df = df.withColumn(column, moments_of(df, column, None, order_by, stats))
    end = F.lit(reference.isoformat(sep=" ")).cast("timestamp_ntz")
    micros = dates.micros_between(named(column), end)
    days = dates.whole_days(micros)
    result = {
        "days": lambda: days,
        "weeks": lambda: days / F.lit(7.0),
        "hours": lambda: micros / F.lit(1e6) / F.lit(3600.0),
        "years": lambda: days / F.lit(365.25),
    }[unit]()
    return df.withColumn(new_column or column, result)
