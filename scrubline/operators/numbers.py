"""Numeric transforms. Those that need whole-column statistics take them from
one fitting job (``fit_*``) and are plain projections after that; fitted
statistics can be passed back in to replay a step on new rows or a stream."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scrubline.frames import is_integral, require_numeric, value
from scrubline.functions import numbers, stats as statistics

ROUNDINGS = ("round", "floor", "ceil")
SCALINGS = ("minmax", "zscore")
MATH = ("abs", "sqrt", "log", "square")
OUTLIER_METHODS = ("iqr", "zscore")
OUTLIER_ACTIONS = ("null", "drop", "clip", "replace", "mean", "median")


def _check(option: str, allowed: Sequence[str], what: str) -> None:
    if option not in allowed:
        raise ValueError(f"no {what} {option!r}; choose one of {', '.join(allowed)}")


def round_numeric(df: DataFrame, column: str, decimals: int, method: str = "round") -> DataFrame:
    require_numeric(df, column)
    _check(method, ROUNDINGS, "rounding method")
    if method == "round" and is_integral(df, column):
        if decimals >= 0:
            return df
        rounded = numbers.round_scaled(value(df, column), decimals, method)
        return df.withColumn(column, rounded.cast(df.schema[column].dataType))
    return df.withColumn(column, numbers.round_scaled(value(df, column), decimals, method))


def clip_numeric(
    df: DataFrame, column: str, lower: float | None = None, upper: float | None = None
) -> DataFrame:
    require_numeric(df, column)
    return df.withColumn(column, numbers.clip(value(df, column), lower, upper))


def apply_math(df: DataFrame, column: str, operation: str) -> DataFrame:
    require_numeric(df, column)
    _check(operation, MATH, "math operation")
    x = value(df, column)
    wide = x.cast("bigint") if is_integral(df, column) else x
    result = {
        # the least whole number has no counterpart: null, as for a square too large
        "abs": lambda: F.when(wide >= 0, wide).otherwise(F.try_subtract(F.lit(0), wide))
        if is_integral(df, column)
        else F.abs(x),
        "sqrt": lambda: F.when(x >= 0, F.sqrt(x)),
        # Spark's ln gives null at zero; the limit is wanted there
        "log": lambda: F.when(x == 0, F.lit(-math.inf)).when(x > 0, F.log(x)),
        "square": lambda: F.try_multiply(wide, wide),
    }[operation]()
    return df.withColumn(column, result)


# ---- scaling ----


def fit_scale(df: DataFrame, column: str, method: str) -> dict[str, float | None]:
    _check(method, SCALINGS, "scaling method")
    require_numeric(df, column)
    m = statistics.moments(df, [column])[column]
    if method == "minmax":
        return {"shift": m.low, "by": None if m.low is None else m.high - m.low}
    return {"shift": m.mean, "by": m.std}


def scale_numeric(df: DataFrame, column: str, method: str, stats: dict | None = None) -> DataFrame:
    """Min-max or z-score scaling; a column without spread stays as it is."""
    require_numeric(df, column)
    _check(method, SCALINGS, "scaling method")
    fitted = stats or fit_scale(df, column, method)
    shift, by = fitted["shift"], fitted["by"]
    if by == 0 or shift is None:
        return df
    x = value(df, column).cast("double")
    # a single row has no deviation, so no z-score
    scaled = F.lit(None).cast("double") if by is None else (x - shift) / by
    return df.withColumn(column, scaled)


# ---- binning ----


def fit_bins(df: DataFrame, column: str, bins: int) -> dict[str, list[float]]:
    require_numeric(df, column)
    if bins < 1:
        raise ValueError("binning needs one interval at least")
    m = statistics.moments(df, [column])[column]
    return {"edges": numbers.bin_edges(m.low, m.high, bins) if m.count else []}


def bin_numeric(
    df: DataFrame,
    column: str,
    bins: int,
    labels: Sequence[str] | None = None,
    new_column: str | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Equal-width, right-closed bins as label text; missing stays missing."""
    require_numeric(df, column)
    if labels is not None and len(labels) != bins:
        raise ValueError(f"{bins} intervals need as many labels")
    edges = (stats or fit_bins(df, column, bins))["edges"]
    target = new_column or column
    if not edges:
        return df.withColumn(target, F.lit(None).cast("string"))
    names = numbers.bin_labels(edges) if labels is None else [str(n) for n in labels]
    index = numbers.bin_index(value(df, column), edges)
    return df.withColumn(target, F.get(F.array(*[F.lit(n) for n in names]), index))


# ---- outliers ----


def _outside(x: Column, fences: dict) -> Column:
    """Strictly beyond a fence; missing values are never outliers."""
    if fences["lower"] is None:
        return F.lit(False)
    return F.coalesce((x < fences["lower"]) | (x > fences["upper"]), F.lit(False))


def _zscore_outside(x: Column, fitted: dict) -> Column:
    if not fitted["std"]:
        return F.lit(False)
    return F.coalesce(F.abs((x - fitted["mean"]) / fitted["std"]) > 3, F.lit(False))


def _outlier(x: Column, method: str, fitted: dict) -> Column:
    return _outside(x, fitted) if method == "iqr" else _zscore_outside(x, fitted)


def iqr_fences(q1: float | None, q3: float | None) -> dict[str, float | None]:
    if q1 is None:
        return {"lower": None, "upper": None}
    return {"lower": q1 - 1.5 * (q3 - q1), "upper": q3 + 1.5 * (q3 - q1)}


def fit_outliers(df: DataFrame, column: str, method: str = "iqr", action: str = "null") -> dict:
    """Fences, and for the mean and median actions the statistic of the rest."""
    require_numeric(df, column)
    _check(method, OUTLIER_METHODS, "outlier method")
    if method == "iqr":
        quartiles = statistics.exact_quantiles(df, {column: [0.25, 0.75]})[column]
        fitted = iqr_fences(quartiles[0.25], quartiles[0.75])
    else:
        m = statistics.moments(df, [column])[column]
        fitted = {"mean": m.mean, "std": m.std, "lower": None, "upper": None}
        if m.std is not None:
            fitted |= {"lower": m.mean - 3 * m.std, "upper": m.mean + 3 * m.std}
    if action in ("mean", "median"):
        x = value(df, column).cast("double")
        rest = df.select(F.when(~_outlier(x, method, fitted), x).alias("rest"))
        fitted["fill"] = _center(rest, "rest", action)
    return fitted


def _center(df: DataFrame, column: str, which: str) -> float | None:
    if which == "mean":
        return statistics.means(df, [column])[column]
    return statistics.exact_quantiles(df, {column: [0.5]})[column][0.5]


def _named_action(action: str, replacement: object) -> str:
    """``replace`` by the words mean or median is the action of that name."""
    if action == "replace" and isinstance(replacement, str):
        if replacement.lower() in ("mean", "median"):
            return replacement.lower()
    return action


def remove_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    action: str = "null",
    value: object = None,
    stats: dict | None = None,
) -> DataFrame:
    require_numeric(df, column)
    _check(method, OUTLIER_METHODS, "outlier method")
    action = _named_action(action, value)
    _check(action, OUTLIER_ACTIONS, "action")
    if action == "replace":
        if value is None:
            raise ValueError("replacing outliers needs the value to put in")
        _require_number(column, value, "outlier replacement")
    fitted = stats or fit_outliers(df, column, method, action)
    x = _present(df, column)
    outlier = _outlier(x.cast("double"), method, fitted)
    if action == "drop":
        return df.where(~outlier)
    if method == "zscore" and not fitted["std"]:
        return df
    if action == "clip":
        return df.withColumn(column, numbers.clip(x, fitted["lower"], fitted["upper"]))
    fill = {"null": None, "replace": value}.get(action, fitted.get("fill"))
    return df.withColumn(column, F.when(outlier, F.lit(fill)).otherwise(x))


def _present(df: DataFrame, column: str) -> Column:
    return value(df, column)


def _require_number(column: str, given: object, what: str) -> None:
    if not isinstance(given, (int, float)):
        raise TypeError(
            f"'{column}' holds numbers, which the {what} {given!r} is not"
        )


# ---- negative values ----


def fit_negatives(df: DataFrame, column: str, replacement_value: object = 0.0) -> dict:
    """The statistic of the non-negative values, zero where there are none."""
    require_numeric(df, column)
    x = value(df, column).cast("double")
    kept = df.select(F.when(x >= 0, x).alias("kept"))
    center = _center(kept, "kept", str(replacement_value).lower())
    return {"fill": 0.0 if center is None else center}


def replace_negative_values(
    df: DataFrame,
    column: str,
    replacement_value: float | str = 0.0,
    stats: dict | None = None,
) -> DataFrame:
    require_numeric(df, column)
    fill = replacement_value
    if isinstance(fill, str):
        if fill.lower() in ("mean", "median"):
            fill = (stats or fit_negatives(df, column, fill))["fill"]
        else:
            try:
                fill = float(fill)
            except ValueError:
                pass
    _require_number(column, fill, "replacement")
    x = value(df, column)
    if is_integral(df, column) and float(fill).is_integer():
        fill = int(fill)
    return df.withColumn(column, F.when(x < 0, F.lit(fill)).otherwise(x))
