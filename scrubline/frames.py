"""What every operator needs to know about a table: names, types, missing
values and row order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_ID = "_row_id"

_FRACTIONAL = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def named(name: str) -> Column:
    """Reference a column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), T.NumericType)


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), T.IntegralType)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), T.StringType)


def is_time(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), _TIMES)


def is_nested(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), _NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_numeric(df, c)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(df, c)]


def value(df: DataFrame, column: str) -> Column:
    """The column with NaN read as missing."""
    if isinstance(type_of(df, column), _FRACTIONAL):
        return F.nanvl(named(column), F.lit(None))
    return named(column)


def count_where(condition: Column) -> Column:
    """Rows for which a condition holds (compiles tighter than ``count_if``)."""
    return F.count(F.when(condition, 1))


def clean_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column."""
    fractional = [c for c in df.columns if isinstance(type_of(df, c), _FRACTIONAL)]
    return df.withColumns({c: value(df, c) for c in fractional}) if fractional else df


def chunked(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"Column '{column}' not found in DataFrame")


def require_numeric(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not is_numeric(df, column):
        raise ValueError(
            f"Column '{column}' holds {type_of(df, column).simpleString()}: convert to numeric first"
        )


def require_batch(df: DataFrame, what: str) -> None:
    """Whole-table work has no answer on an unbounded stream."""
    if df.isStreaming:
        raise ValueError(
            f"{what} needs the whole table; on a stream pass statistics fitted on a batch snapshot"
        )


def order_columns(df: DataFrame, order_by: str | Sequence[str] | None) -> list[str]:
    """The columns that give row order; never guessed."""
    if order_by is None:
        if ROW_ID in df.columns:
            return [ROW_ID]
        raise ValueError(f"row order is needed: pass order_by or read with {ROW_ID}")
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    require_columns(df, columns)
    return columns


def literal(text: str | None, dtype: T.DataType) -> Column:
    """A typed constant from its Spark text form (safe for every time zone)."""
    return F.lit(text).cast(dtype)
