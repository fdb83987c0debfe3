"""Text transforms: each one projection, null stays null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scrubline.frames import is_text, named, require_columns
from scrubline.functions import text

CASES: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "title": text.title,
}
PAD_SIDES = ("left", "right", "both")


def _change(df: DataFrame, column: str, change: Callable[[Column], Column]) -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(column, change(named(column).cast("string")))


def _change_all(df: DataFrame, columns: Sequence[str], change) -> DataFrame:
    """Change the string columns among ``columns``; skip the rest."""
    chosen = [c for c in dict.fromkeys(columns) if c in df.columns and is_text(df, c)]
    return df.withColumns({c: change(named(c)) for c in chosen}) if chosen else df


def _trimmed(c: Column) -> Column:
    return text.blank_to_null(text.strip(c))


def trim_spaces(df: DataFrame, column: str) -> DataFrame:
    return _change(df, column, _trimmed)


def trim_spaces_batch(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _change_all(df, columns, _trimmed)


def standardize_case(df: DataFrame, column: str, case: str) -> DataFrame:
    if case not in CASES:
        raise ValueError(f"no letter case {case!r}; cases are {', '.join(CASES)}")
    return _change(df, column, CASES[case])


def standardize_case_batch(df: DataFrame, columns: Sequence[str], case: str) -> DataFrame:
    return _change_all(df, columns, CASES[case]) if case in CASES else df


def replace_text(df: DataFrame, column: str, old_val: str, new_val: str) -> DataFrame:
    if not old_val:
        raise ValueError("the text to replace must not be empty")
    return _change(
        df, column, lambda c: text.blank_to_null(F.replace(c, F.lit(old_val), F.lit(new_val)))
    )


def replace_text_regex(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    return _change(
        df, column, lambda c: text.blank_to_null(text.regex_replace(c, pattern, replacement))
    )


def remove_special_chars(df: DataFrame, column: str) -> DataFrame:
    return _change(df, column, lambda c: text.blank_to_null(text.keep_alphanumeric(c)))


def pad_string(
    df: DataFrame, column: str, width: int, fillchar: str = "0", side: str = "left"
) -> DataFrame:
    if side not in PAD_SIDES:
        raise ValueError(f"text has no side {side!r}; sides are {', '.join(PAD_SIDES)}")
    if not isinstance(fillchar, str) or len(fillchar) != 1:
        raise TypeError("text is padded with exactly one character")
    return _change(df, column, lambda c: text.pad(c, width, fillchar, side))


def slice_string(df: DataFrame, column: str, start: int = 0, end: int | None = None) -> DataFrame:
    return _change(
        df, column, lambda c: text.blank_to_null(text.python_slice(c, start or 0, end))
    )


def add_prefix_suffix(df: DataFrame, column: str, prefix: str = "", suffix: str = "") -> DataFrame:
    return _change(df, column, lambda c: F.concat(F.lit(prefix), c, F.lit(suffix)))
