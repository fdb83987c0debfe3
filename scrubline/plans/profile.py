"""Profile of one column or of the numeric columns together."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import (
    chunked, data_columns, is_numeric, is_time, named, numeric_columns, require_batch,
    require_columns, require_numeric, type_of, value,
)
from scrubline.functions import dates, numbers, stats

MAX_DISTINCT_BARS = 20
HISTOGRAM_BINS = 20
TOP_VALUES = 20

# Rows looked at before the distinct values of a whole column are counted.
PROOF_ROWS = 1_000
QUARTILES = (0.25, 0.5, 0.75)

# Pairs per aggregate of the correlation matrix.
PAIRS_PER_SCAN = 200

# Rows looked at to find a constant near the middle of each column, and the share of its squares that a
# spread must have to be told from rounding.
SHIFT_ROWS, UNSURE = 1_000, 1e-7


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """(statistic, value) rows: moments and quartiles of numbers and times,
    count, distinct values and the top value of anything else."""
    require_batch(df, "a column description")
    require_columns(df, [column])
    spark = df.sparkSession
    if is_numeric(df, column):
        m = stats.moments(df, [column])[column]
        q = stats.exact_quantiles(df, {column: QUARTILES}, {column: m.count})[column]
        rows = [("count", float(m.count)), ("mean", m.mean), ("std", m.std), ("min", m.low)]
        rows += [(f"{int(p * 100)}%", q[p]) for p in QUARTILES] + [("max", m.high)]
        return spark.createDataFrame(rows, "statistic string, value double")
    if is_time(df, column):
        return _describe_times(df, column)
    n, v = F.col("n"), F.col("v")
    found = (
        df.select(value(df, column).alias("v"))
        .where(v.isNotNull())
        .groupBy("v")
        .agg(F.count("*").alias("n"))
        .agg(
            F.sum("n").alias("count"), F.count("*").alias("unique"),
            F.min(F.struct((-n).alias("n"), v.alias("v"))).alias("top"),
        )
        .select("count", "unique", F.col("top.v").cast("string").alias("top"), (-F.col("top.n")).alias("freq"))
        .first()
    )
    rows = [("count", str(found["count"] or 0)), ("unique", str(found["unique"])), ("top", found["top"])]
    rows.append(("freq", str(found["freq"]) if found["freq"] else None))
    return spark.createDataFrame(rows, "statistic string, value string")


def _describe_times(df: DataFrame, column: str) -> DataFrame:
    micros = df.select(dates.epoch_micros(named(column)).alias("micros"))
    m = stats.moments(micros, ["micros"])["micros"]
    q = stats.exact_quantiles(micros, {"micros": QUARTILES}, {"micros": m.count})["micros"]
    rows = [("mean", m.mean), ("min", m.low)]
    rows += [(f"{int(p * 100)}%", q[p]) for p in QUARTILES] + [("max", m.high)]
    moments = df.sparkSession.createDataFrame(
        [(s, None if x is None else int(x)) for s, x in rows], "statistic string, micros bigint"
    ).select("statistic", dates.from_epoch_micros(F.col("micros")).cast("string").alias("value"))
    count = df.sparkSession.createDataFrame([("count", str(m.count))], "statistic string, value string")
    return count.union(moments)


def numeric_distribution(df: DataFrame, column: str) -> DataFrame:
    """(position, bucket, count): the values themselves while they are few,
    else 20 equal-width right-closed bins with the empty ones kept."""
    require_numeric(df, column)
    require_batch(df, "a distribution")
    present = df.select(value(df, column).alias("v")).where(F.col("v").isNotNull())
    # a few rows can prove that the values are many, and only that
    many = len({r["v"] for r in present.head(PROOF_ROWS)}) > MAX_DISTINCT_BARS
    few = not many and present.distinct().limit(MAX_DISTINCT_BARS + 1).count() <= MAX_DISTINCT_BARS
    if few:
        counted = present.groupBy("v").agg(F.count("*").alias("count"))
        # at most twenty rows are ranked here
        rows = sorted((r["v"], r["count"]) for r in counted.collect())
        named_rows = [(i, str(v), n) for i, (v, n) in enumerate(rows)]
    else:
        m = stats.moments(df, [column])[column]
        edges = numbers.bin_edges(m.low, m.high, HISTOGRAM_BINS)
        binned = present.groupBy(numbers.bin_index(F.col("v"), edges).alias("bin")).agg(
            F.count("*").alias("n")
        )
        counts = {r["bin"]: r["n"] for r in binned.collect()}
        labels = numbers.bin_labels(edges, lower_first=True)
        named_rows = [(i, label, counts.get(i, 0)) for i, label in enumerate(labels)]
    return df.sparkSession.createDataFrame(named_rows, "position int, bucket string, count bigint")


def categorical_distribution(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """The most common values and their counts, the lower value first on ties."""
    require_columns(df, [column])
    v = value(df, column)
    return (
        df.where(v.isNotNull())
        .groupBy(v.alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(n)
    )


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r over complete pairs, null without spread (the built-in one divides by zero there and fails).

    Extremes tell whether there is any: a deviation merged from many tasks may be off zero by rounding.
    """
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    varied = (F.max(a) != F.min(a)) & (F.max(b) != F.min(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), spread))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation of all pairs of 64-bit numeric columns in long form.

    Each pair is computed once, over the rows where both are present. Few columns take one
    aggregate; many take one scan that sums cross products (``_pair_moments``).
    """
    require_batch(df, "a correlation")
    columns = [
        c for c in data_columns(df) if isinstance(type_of(df, c), (T.LongType, T.DoubleType))
    ]
    if len(columns) < 2:
        raise ValueError("Need at least 2 numeric columns.")
    pairs = list(combinations(columns, 2))
    if len(pairs) <= PAIRS_PER_SCAN:
        found = _pair_by_pair(df, pairs)
        spread = df.agg(*[F.max(_double(df, c)) != F.min(_double(df, c)) for c in columns]).first()
        varied = {c for c, differs in zip(columns, spread) if differs}
    else:
        found, varied = _pair_moments(df, columns)
    rows = []
    for variable in columns:
        for index in columns:
            if index == variable:
                r = 1.0 if index in varied else None
            else:
                r = found[(index, variable) if (index, variable) in found else (variable, index)]
            rows.append((index, variable, r))
    return df.sparkSession.createDataFrame(rows, "index string, variable string, value double")


def _double(df: DataFrame, column: str) -> Column:
    return value(df, column).cast("double")


def _pair_by_pair(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    found: dict[tuple[str, str], float | None] = {}
    for chunk in chunked(list(pairs), PAIRS_PER_SCAN):
        row = df.agg(*[_correlation(_double(df, a), _double(df, b)) for a, b in chunk]).first()
        found.update(zip(chunk, row))
    return found


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> tuple[dict[tuple[str, str], float | None], set[str]]:
    """Correlations of all pairs, and the columns with any spread, from one scan of many columns.

    Each row becomes a vector of its values (less a constant near their middle, for accuracy), whether each
    is present, and the squares. The sums of products of any two of these, a matrix that
    tasks add up in a tree, hold for every pair the count, sums and squares over its complete
    rows. Where a spread is too small beside its squares to be told from rounding, the pair is computed anew.
    """
    p = len(columns)
    some = df.select(*[_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)]).limit(SHIFT_ROWS)
    middles = some.agg(*[F.avg(f"x{i}") for i in range(p)]).first()
    moved = [_double(df, c) - F.lit(m or 0.0) for c, m in zip(columns, middles)]
    present = [F.when(x.isNull(), 0.0).otherwise(1.0) for x in moved]
    held = [F.coalesce(x, F.lit(0.0)) for x in moved]
    vector = array_to_vector(F.array(*held, *present, *[x * x for x in held]))
    rows = MLUtils.convertVectorColumnsFromML(df.select(vector.alias("v")), "v")
    gram = RowMatrix(rows, 0, 3 * p).computeGramianMatrix().toArray()
    n, x, xx, xy = gram[p : 2 * p, p : 2 * p], gram[:p, p : 2 * p], gram[2 * p :, p : 2 * p], gram[:p, :p]
    spread = n * xx - x * x
    unsure = spread <= UNSURE * n * np.maximum(xx, np.finfo(float).tiny)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * xy - x * x.T) / np.sqrt(spread * spread.T)
    pairs = list(combinations(range(p), 2))
    again = [(i, j) for i, j in pairs if (unsure[i, j] or unsure[j, i]) and n[i, j] > 1]
    found = {(columns[i], columns[j]): float(np.clip(r[i, j], -1, 1)) if n[i, j] > 1 else None for i, j in pairs}
    found |= _pair_by_pair(df, [(columns[i], columns[j]) for i, j in again])
    flat = [i for i in range(p) if unsure[i, i]]
    varied = {c for i, c in enumerate(columns) if i not in flat}
    for chunk in chunked(flat, PAIRS_PER_SCAN):
        row = df.agg(*[F.max(_double(df, columns[i])) != F.min(_double(df, columns[i])) for i in chunk]).first()
        varied |= {columns[i] for i, differs in zip(chunk, row) if differs}
    return found, varied


def box_plot_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, and whiskers at the extremes."""
    require_numeric(df, column)
    m = stats.moments(df, [column])[column]
    q = stats.exact_quantiles(df, {column: QUARTILES}, {column: m.count})[column]
    return df.sparkSession.createDataFrame(
        [(m.low, q[0.25], q[0.5], q[0.75], m.high)],
        "min double, q1 double, median double, q3 double, max double",
    )


def scatter_data(
    df: DataFrame, x: str, y: str, fraction: float | None = None, seed: int = 0
) -> DataFrame:
    """Two numeric columns, all rows; a random share of them only if asked for."""
    require_numeric(df, x)
    require_numeric(df, y)
    points = df.select(named(x).alias("x"), named(y).alias("y"))
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The statistics the cleaning steps use, one row per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    for c in columns:
        require_numeric(df, c)
    m = stats.moments(df, columns)
    q = stats.exact_quantiles(df, {c: QUARTILES for c in columns}, {c: m[c].count for c in columns})
    modes = {c: text for c, (text, _) in stats.top_values(df, columns).items()}
    rows = [
        (c, m[c].mean, q[c][0.5], float(modes[c]) if modes[c] is not None else None, m[c].std,
         m[c].low, m[c].high, q[c][0.25], q[c][0.75])
        for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, mean double, median double, mode double, std double, min double, "
        "max double, q1 double, q3 double",
    )

