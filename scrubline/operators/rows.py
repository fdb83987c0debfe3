"""Duplicate rows and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import ROW_ID, data_columns, named, order_columns, require_batch, require_columns, type_of, value

KEEP = ("first", "last", False)


def _is_map(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), T.MapType)


def _keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Grouping keys under their own names, NaN and missing as one, maps as sorted entries."""
    return [
        (F.sort_array(F.map_entries(named(c))) if _is_map(df, c) else value(df, c)).alias(c) for c in columns
    ]


def deduplicate_rows(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row of each set of copies (or none of them with ``keep=False``).

    Copies meet in an aggregate, not in a window, so they are thinned out on
    the map side and a set of copies of any size never gathers in one task.
    """
    require_batch(df, "removing duplicates")
    if keep not in KEEP:
        raise ValueError(f"of equal rows the first, the last or none can stay, not {keep!r}")
    keys = list(subset) if subset else data_columns(df)
    require_columns(df, keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*_keys(df, keys))
    record = F.struct(*[named(c) for c in rest]) if rest else None
    if keep is False:
        chosen = F.first(record) if rest else F.lit(None)
        unique = grouped.agg(F.count("*").alias("__n"), chosen.alias("__row")).where("__n = 1")
        return _unfold(unique, df, keys, rest)
    if not rest:
        return _unfold(grouped.agg(F.lit(None).alias("__row")), df, keys, rest)
    order = F.struct(*[named(o) for o in order_columns(df, order_by)])
    pick = F.min_by if keep == "first" else F.max_by
    return _unfold(grouped.agg(pick(record, order).alias("__row")), df, keys, rest)


def _of_key(df: DataFrame, column: str) -> Column:
    return F.map_from_entries(named(column)).alias(column) if _is_map(df, column) else named(column)


def _unfold(grouped: DataFrame, df: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    return grouped.select(
        *[_of_key(df, c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns]
    )


def duplicate_count(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """How many rows repeat an earlier one on the given columns."""
    require_batch(df, "counting duplicates")
    require_columns(df, subset)
    return (
        df.groupBy(*_keys(df, subset))
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def preview_rows(df: DataFrame, n: int = 50, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows in row order."""
    order = order_columns(df, order_by)
    return df.orderBy(*[named(o) for o in order]).limit(n)


__all__ = ["ROW_ID", "deduplicate_rows", "duplicate_count", "preview_rows"]
