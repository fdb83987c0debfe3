"""Filling and dropping missing values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from scrubline.frames import (
    ROW_ID, is_nested, is_numeric, is_text, literal, named, order_columns, require_batch, require_columns,
    require_numeric, type_of, value,
)
from scrubline.functions import stats
from scrubline.session import cut_lineage

FILL_METHODS = ("mean", "median", "mode", "zero", "ffill", "bfill", "custom")

# Rows filled together along row order; ranges grow where there would be more of them than MAX_RANGES.
ROWS_PER_RANGE = 250_000
MAX_RANGES = 20_000

# Spark's range partitioning brings some 300 sampled rows per partition to the driver. Rows are sorted into one
# partition for ROWS_PER_RANGE rows, within these bounds, however many ranges the partitions are cut into then.
LEAST_PARTITIONS, MOST_PARTITIONS = 64, 2_000


def drop_rows_with_nulls(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.where(value(df, column).isNotNull())


def fit_fill(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, object]:
    """The fill value of each column: a number, or Spark text for a mode."""
    if method in ("mean", "median"):
        for c in columns:
            require_numeric(df, c)
    if method == "mean":
        return stats.means(df, columns)
    if method == "median":
        found = stats.exact_quantiles(df, {c: [0.5] for c in columns})
        return {c: found[c][0.5] for c in columns}
    if method == "mode":
        return {c: text for c, (text, _) in stats.top_values(df, columns).items()}
    return {}


def fill_nulls(
    df: DataFrame,
    column: str,
    method: str,
    value: object = None,
    order_by: str | Sequence[str] | None = None,
    stats: dict | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Fill one column; wrong methods and values are refused before any work."""
    require_columns(df, [column])
    if method not in FILL_METHODS:
        raise ValueError(f"no fill method {method!r}; methods are {', '.join(FILL_METHODS)}")
    if method in ("mean", "median"):
        require_numeric(df, column)
    if method == "zero" and isinstance(type_of(df, column), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"Column '{column}' holds dates; there is no zero to fill them with")
    if method in ("mode", "zero") and is_nested(df, column):
        raise ValueError(f"Column '{column}' holds nested values, which cannot be filled by {method}")
    if method == "custom":
        if value is None:
            raise ValueError("a custom fill needs the value to put in")
        _require_fit(df, column, value)
        if is_numeric(df, column) and not isinstance(value, (int, float)):
            raise TypeError(
                f"'{column}' holds numbers, which {value!r} is not"
            )
    return fill_nulls_batch(df, [column], method, value, order_by=order_by, stats=stats, within=within)


# Bits of the whole-number types.
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _require_fit(df: DataFrame, column: str, fill: object) -> None:
    """Refuse a value that the column's type cannot hold, before any work."""
    dtype = type_of(df, column)
    bits = _BITS.get(type(dtype))
    if bits and isinstance(fill, int) and not -(1 << bits - 1) <= fill < 1 << bits - 1:
        raise ValueError(f"Column '{column}' is {dtype.simpleString()}, too narrow for {fill}")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        kind = dtype.simpleString()
        text = str(fill).replace("'", "''")
        if df.sparkSession.sql(f"SELECT try_cast('{text}' AS {kind}) IS NULL").first()[0]:
            raise ValueError(f"Column '{column}' is {kind}, which '{fill}' is not")


def fill_nulls_batch(
    df: DataFrame,
    columns: Sequence[str],
    method: str,
    value: object = None,
    order_by: str | Sequence[str] | None = None,
    stats: dict | None = None,
    rows_per_range: int | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Fill many columns in one projection.

    ``ffill`` and ``bfill`` go along ``order_by`` (one or more columns, missing first; ties by the
    table's other plain columns, left to right), and only within rows that agree in ``within``.

    Unknown columns and methods change nothing; mean and median leave other
    than numeric columns alone.
    """
    columns = [c for c in dict.fromkeys(columns) if c in df.columns]
    if method in ("mean", "median"):
        columns = [c for c in columns if is_numeric(df, c)]
    elif method not in ("ffill", "bfill"):
        columns = [c for c in columns if not is_nested(df, c)]
    if not columns:
        return df
    if method in ("ffill", "bfill"):
        return _fill_along(df, columns, order_by, method == "ffill", rows_per_range or ROWS_PER_RANGE, within)
    if method in ("mean", "median", "mode"):
        fills = stats if stats is not None else fit_fill(df, columns, method)
    elif method == "zero" or (method == "custom" and value is not None):
        fills = dict.fromkeys(columns, 0 if method == "zero" else value)
    else:
        return df
    return df.withColumns(
        {c: _filled(df, c, fills[c]) for c in columns if fills.get(c) is not None}
    )


def _filled(df: DataFrame, column: str, fill: object) -> Column:
    dtype = type_of(df, column)
    present = value(df, column)
    if isinstance(fill, str):
        return F.coalesce(present, literal(fill, dtype))
    if is_numeric(df, column):
        fits = not isinstance(fill, float) or isinstance(dtype, (T.DoubleType, T.DecimalType))
        # a fraction put into a whole-number column makes it a double column
        fill = int(fill) if isinstance(fill, bool) else fill
        return F.coalesce(present, F.lit(fill).cast(dtype) if fits else F.lit(fill))
    if is_text(df, column):
        return F.coalesce(present, F.lit(str(fill)))
    return F.coalesce(present, F.lit(fill).try_cast(dtype))


def _fill_along(
    df: DataFrame, columns: Sequence[str], order_by, forward: bool, rows_per_range: int, within: Sequence[str]
) -> DataFrame:
    """Carry the nearest value along row order over the whole table, or within groups of it.

    A segmented scan: one window over everything would be one task, and so would a group that holds
    a third of all rows. The rows are sorted by group and order by Spark's own range partitioning,
    numbered in that order, cut into ranges by these numbers, and written. Each
    range is filled on its own, and what it misses comes from a table of one row per range: the last
    value known in the ranges before it, if these end in the group it begins with.
    """
    require_batch(df, "filling along row order")
    order = order_columns(df, order_by)
    require_columns(df, within)
    for c in [*within, *order]:
        if is_nested(df, c):
            raise ValueError(f"Column '{c}' holds nested values, which give no row order")
    place = [value(df, c) for c in _sorted_by(df, within, order)]
    groups = [value(df, c) for c in within]

    # both directions look back over rows already passed: a frame that looks
    # ahead is evaluated anew for every row
    def toward(column: Column) -> Column:
        return column.asc_nulls_first() if forward else column.desc_nulls_last()

    def filled(rows: DataFrame, keys: list[Column], order: list[Column]) -> dict[str, Column]:
        passed = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*map(toward, order))
        passed = passed.rowsBetween(W.unboundedPreceding, 0)
        return {c: F.last(value(rows, c), ignorenulls=True).over(passed) for c in columns}

    n = df.count()
    ranges = min(MAX_RANGES, math.ceil(n / rows_per_range))
    if ranges <= 1:
        return df.withColumns(filled(df, groups, place))
    partitions = min(ranges, MOST_PARTITIONS, max(LEAST_PARTITIONS, math.ceil(n / ROWS_PER_RANGE)))
    dealt = df.repartitionByRange(partitions, *[c.asc_nulls_first() for c in place])
    dealt = dealt.sortWithinPartitions(*[c.asc_nulls_first() for c in place])
    rows = cut_lineage(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    # the upper bits of the number tell the partition, in sorted order, the lower ones the place in it
    place_in = F.col("__at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("__range", F.col("__at") - place_in + F.floor(place_in / math.ceil(n / ranges)))
    carried = _carried(rows, columns, groups, forward, toward)
    inside = rows.withColumns(filled(rows, [F.col("__range"), *groups], [F.col("__at")]))
    same = F.col("__range") == F.col("__to")
    if within:
        same &= F.struct(*groups).eqNullSafe(F.col("__group"))
    # one row per range: MAX_RANGES at most, and one more for each partition
    joined = inside.join(F.broadcast(carried), same, "left")
    return joined.select(
        *[F.coalesce(named(c), F.col(f"__c{columns.index(c)}")).alias(c) if c in columns else named(c) for c in df.columns]
    )


def _sorted_by(df: DataFrame, within: Sequence[str], order: Sequence[str]) -> list[str]:
    """Groups, order, and then the table's other plain columns from left to right, which settle ties."""
    first = [*within, *order]
    if ROW_ID in order:
        return first
    return [*first, *[c for c in df.columns if c not in first and not is_nested(df, c)]]


def _carried(rows: DataFrame, columns: Sequence[str], groups: list[Column], forward: bool, toward) -> DataFrame:
    """For each range (``__to``) the group it begins with and the last values of that group before it.

    Every range tells which group its far end lies in and the last values it knows of that group; a
    range asks for those of the group at its near end. Asked and told are put in one order per group.
    """
    farthest, nearest = (F.max_by, F.min_by) if forward else (F.min_by, F.max_by)
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    known = {c: F.when(value(rows, c).isNotNull(), F.col("__at")) for c in columns}
    ends = rows.withColumn("__group", group).groupBy("__range").agg(
        nearest("__group", "__at").alias("begins"), farthest("__group", "__at").alias("ends"),
        *[
            farthest(F.struct("__group", value(rows, c).alias("v")), known[c]).alias(f"__c{i}")
            for i, c in enumerate(columns)
        ],
    )
    told, asked = [], []
    for i in range(len(columns)):
        last = F.col(f"__c{i}")
        told.append(F.when(last["__group"].eqNullSafe(F.col("ends")), last["v"]).alias(f"__c{i}"))
        asked.append(F.lit(None).alias(f"__c{i}"))
    both = ends.select(F.col("ends").alias("__group"), "__range", F.lit(1).alias("told"), *told).union(
        ends.select("begins", "__range", F.lit(0), *asked)
    )
    before = W.partitionBy("__group").orderBy(toward(F.col("__range")), "told").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(f"__c{i}", ignorenulls=True).over(before).alias(f"__c{i}") for i in range(len(columns))]
    return both.select(F.col("__range").alias("__to"), "__group", "told", *last).where("told = 0").drop("told")
