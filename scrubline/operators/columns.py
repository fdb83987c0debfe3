"""Adding, removing, splitting and joining columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scrubline.frames import ROW_ID, named, require_columns, value
from scrubline.functions import text
from scrubline.functions.formulas import formula_column


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.drop(column)


def drop_columns_batch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    require_columns(df, [column])
    if new_name in df.columns:
        raise ValueError(f"the table has a '{new_name}' already; choose another name")
    return df.withColumnRenamed(column, new_name)


def reorder_columns(df: DataFrame, column_order: Sequence[str]) -> DataFrame:
    """The given columns first, the others after them as they stood."""
    require_columns(df, column_order)
    rest = [c for c in df.columns if c not in column_order]
    return df.select(*[named(c) for c in [*column_order, *rest]])


def split_column(
    df: DataFrame,
    column: str,
    delimiter: str,
    new_columns: Sequence[str],
    keep_original: bool = False,
) -> DataFrame:
    """Cut text at a literal delimiter; missing and blank parts are null."""
    require_columns(df, [column])
    if not delimiter:
        raise ValueError("the delimiter must not be empty")
    parts = text.split_literal(named(column).cast("string"), delimiter)
    result = df.withColumns(
        {
            name: text.blank_to_null(text.strip(F.get(parts, F.lit(i))))
            for i, name in enumerate(new_columns)
        }
    )
    return result if keep_original or column in new_columns else result.drop(column)


def merge_columns(
    df: DataFrame,
    columns: Sequence[str],
    separator: str,
    new_column: str,
    drop_original: bool = True,
) -> DataFrame:
    """Join the non-missing values of a row with a separator."""
    require_columns(df, columns)
    joined = F.concat_ws(separator, *[value(df, c).cast("string") for c in columns])
    result = df.withColumn(new_column, text.blank_to_null(joined))
    return result.drop(*[c for c in columns if c != new_column]) if drop_original else result


def create_calculated_column(df: DataFrame, new_column_name: str, formula: str) -> DataFrame:
    """A new column from a formula over the others (``functions/formulas.py`` tells what it may hold)."""
    if new_column_name in df.columns:
        raise ValueError(f"the table has a '{new_column_name}' already; choose another name")
    return df.withColumn(new_column_name, formula_column(df, formula))


def without_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)
