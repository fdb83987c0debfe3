"""Conversions between logical types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from scrubline.frames import is_nested, is_numeric, is_text, named, require_batch, require_columns, type_of, value
from scrubline.functions import numbers, text
from scrubline.operators.dates import fit_format, moments_of
from scrubline.session import cut_lineage

TARGETS = ("numeric", "string", "datetime", "boolean", "categorical")
BATCH_TARGETS = ("numeric", "string", "datetime")

# Texts read as true and as false, in any case, edges stripped.
TRUE_TEXTS = ["true", "yes", "1", "1.0", "t", "y"]
FALSE_TEXTS = ["false", "no", "0", "0.0", "f", "n"]


def _numeric(df: DataFrame, column: str) -> Column:
    if is_text(df, column):
        return numbers.parse_number(named(column))
    if isinstance(type_of(df, column), T.BooleanType):
        return named(column).cast("double")
    return value(df, column)


def _boolean(df: DataFrame, column: str) -> Column:
    if isinstance(type_of(df, column), T.BooleanType):
        return named(column)
    said = text.strip(F.lower(value(df, column).cast("string")))
    return F.when(said.isin(TRUE_TEXTS), F.lit(True)).when(said.isin(FALSE_TEXTS), F.lit(False))


def category_frame(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column and how often each occurs, in order."""
    require_batch(df, "listing categories")
    return (
        df.select(value(df, column).alias("category"))
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("count"))
        .orderBy("category")
    )


def fit_categories(df: DataFrame, column: str) -> dict:
    """What column metadata says of a category column; ``category_frame`` lists its values, however many."""
    require_columns(df, [column])
    return {"categorical": True}


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(category, code) for the distinct values of a column: codes from 0 on, without gaps, in the order of the values.

    For any number of categories: these are sorted into ranges by Spark's range partitioning and
    numbered within each; a table of one row per range, as many as shuffle partitions, holds what to add.
    """
    require_batch(df, "numbering categories")
    require_columns(df, [column])
    if is_nested(df, column):
        raise ValueError(f"Column '{column}' holds nested values, which make no categories")
    distinct = df.select(value(df, column).alias("category")).where(F.col("category").isNotNull()).distinct()
    dealt = distinct.repartitionByRange("category").sortWithinPartitions("category")
    numbered = cut_lineage(dealt.withColumn("__id", F.monotonically_increasing_id()), "categories")
    # the upper bits of the number tell the range, the others the place in it
    numbered = numbered.select(
        "category", F.shiftright("__id", 33).alias("__range"), F.col("__id").bitwiseAND(2**33 - 1).alias("__place")
    )
    before = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("__n"))
    firsts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = numbered.join(F.broadcast(firsts), "__range")  # one row per shuffle partition
    return placed.select("category", (F.col("__first") + F.col("__place")).alias("code"))


def encode_categories(df: DataFrame, column: str, new_column: str | None = None) -> DataFrame:
    """The table with each row's category code; -1 where the value is missing."""
    target = new_column or f"{column}_code"
    if target != column and target in df.columns:
        raise ValueError(f"the table has a '{target}' already; choose another name")
    codes = category_codes(df, column).withColumnsRenamed({"category": "__category", "code": "__code"})
    joined = df.join(codes, value(df, column) == F.col("__category"), "left")
    code = F.coalesce("__code", F.lit(-1).cast("bigint")).alias(target)
    kept = [code if c == target else named(c) for c in df.columns]
    return joined.select(*kept, *([] if target in df.columns else [code]))


def is_categorical(df: DataFrame, column: str) -> bool:
    """Whether a column was converted to categories."""
    return bool(df.schema[column].metadata.get("categorical"))


def convert_column_type(
    df: DataFrame,
    column: str,
    target_type: str,
    order_by: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Convert one column; values that do not convert become null."""
    require_columns(df, [column])
    if target_type not in TARGETS:
        raise ValueError(f"no type {target_type!r}; types are {', '.join(TARGETS)}")
    if target_type == "numeric":
        return df.withColumn(column, _numeric(df, column))
    if target_type == "string":
        return df.withColumn(column, value(df, column).cast("string"))
    if target_type == "datetime":
        return df.withColumn(column, moments_of(df, column, None, order_by, stats))
    if target_type == "boolean":
        return df.withColumn(column, _boolean(df, column))
    return df.withMetadata(column, stats or fit_categories(df, column))


def convert_columns_batch(
    df: DataFrame, columns: Sequence[str], target_type: str, order_by: str | None = None
) -> DataFrame:
    """Convert many columns in one projection; unknown names and targets skip."""
    columns = [c for c in dict.fromkeys(columns) if c in df.columns]
    if target_type not in BATCH_TARGETS or not columns:
        return df
    change = {
        "numeric": lambda c: _numeric(df, c),
        "string": lambda c: value(df, c).cast("string"),
        "datetime": lambda c: moments_of(df, c, None, order_by),
    }[target_type]
    return df.withColumns({c: change(c) for c in columns})


__all__ = [
    "TARGETS", "category_codes", "category_frame", "convert_column_type", "convert_columns_batch",
    "encode_categories", "fit_categories", "fit_format", "is_categorical", "is_numeric",
]
