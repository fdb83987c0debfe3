"""Quality checks: what is wrong with a table, column by column.

All counts of all columns come from one aggregate over one scan; the checks
themselves only read those counts. Results are plain dictionaries whose size
depends on the number of columns, never of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import (
    chunked, count_where, data_columns, is_numeric, is_text, is_time, named, numeric_columns, require_batch, text_columns,
    type_of, value,
)
from scrubline.functions import dates, numbers, stats, text
from scrubline.operators.numbers import iqr_fences

# Thresholds of the checks.
MIN_VALUES_FOR_TYPE = 5
NUMERIC_SHARE = 0.8
DATETIME_SHARE = 0.6
DATETIME_CHOICE_SHARE = 0.8
CASE_SHARE = (0.1, 0.9)
MIN_VALUES_FOR_OUTLIERS = 10

# Columns per aggregate: keeps generated code within the compiler's limits. Each
# column of a columnar file is still read only once.
COLUMNS_PER_SCAN = 24

TYPES = "types"
CONTENT = "content"
LEADING = "leading"


def _type_counts(df: DataFrame, column: str) -> dict[str, Column]:
    if not is_text(df, column):
        return {}
    c = named(column)
    # most text fails this look at its first character and is parsed no further
    candidate = c.rlike(r"^\s*[-+.\diI]")
    parsed = {"numbers": F.count(F.when(candidate, numbers.parse_number(c)))}
    for i, fmt in enumerate(dates.INFERENCE_FORMATS):
        parsed[f"date{i}"] = F.count(F.when(candidate, dates.parse_format(c, fmt)))
    return parsed


def _content_counts(df: DataFrame, column: str) -> dict[str, Column]:
    if is_text(df, column):
        c = named(column)
        return {
            "spaces": count_where(text.has_edge_space(c)),
            "lower": count_where(text.is_lower(c)),
            "upper": count_where(text.is_upper(c)),
            "blank": count_where(text.is_blank(c)),
        }
    if is_numeric(df, column):
        x = value(df, column)
        return {"negative": count_where(x < 0), "low": F.min(x), "high": F.max(x)}
    return {}


def scan_columns(
    df: DataFrame, wants: Iterable[str] = (TYPES, CONTENT), columns: Iterable[str] | None = None
) -> dict[str, dict]:
    """The raw counts behind the column checks, one dictionary per column."""
    require_batch(df, "a quality check")
    columns = data_columns(df) if columns is None else list(columns)
    found: dict[str, dict] = {}
    for chunk in chunked(columns, COLUMNS_PER_SCAN):
        wanted = []
        for c in chunk:
            counts = {"rows": F.count("*"), "present": F.count(value(df, c))}
            if TYPES in wants:
                counts |= _type_counts(df, c)
            if CONTENT in wants:
                counts |= _content_counts(df, c)
            if LEADING in wants and is_text(df, c):
                counts["leading"] = count_where(text.starts_spaced(named(c)))
            wanted.append(counts)
        aggregates = [
            a.alias(f"{i}_{name}") for i, counts in enumerate(wanted) for name, a in counts.items()
        ]
        row = df.agg(*aggregates).first()
        for i, (c, counts) in enumerate(zip(chunk, wanted)):
            found[c] = {name: row[f"{i}_{name}"] for name in counts}
    return found


# ---- dataset level ----


def dataset_level_checks(df: DataFrame) -> dict[str, int]:
    columns = data_columns(df)
    if not columns:
        return {"row_count": 0, "column_count": 0, "duplicate_rows": 0, "fully_empty_rows": 0}
    total, distinct, empty = _row_counts(df, columns)
    return {
        "row_count": total,
        "column_count": len(columns),
        "duplicate_rows": total - distinct,
        "fully_empty_rows": empty,
    }


def _row_counts(df: DataFrame, columns: list[str]) -> tuple[int, int, int]:
    """Rows, distinct rows and fully empty rows.

    Grouping by whole rows would shuffle the whole table. Rows are grouped by a
    128-bit fingerprint first: fingerprints that occur once are distinct rows for
    certain. Only rows sharing one are compared in full, picked out by a semi-join
    that adaptive execution broadcasts or shuffles as their number allows.
    """
    require_batch(df, "counting duplicates")
    keyed = _comparable(df, columns)
    keyed = keyed.select(*_fingerprint(keyed, columns), *[named(c) for c in columns])
    groups = keyed.groupBy("__h1", "__h2").agg(
        F.count("*").alias("n"),
        count_where(_all_missing(columns)).alias("empty"),
    )
    summary = groups.agg(
        F.sum("n"), F.count("*"), count_where(F.col("n") > 1), F.sum("empty")
    ).first()
    total, shapes, shared = summary[0] or 0, summary[1], summary[2]
    empty = summary[3] or 0
    if not shared:
        return total, shapes, empty
    suspects = groups.where("n > 1").select("__h1", "__h2")
    rows = keyed.join(suspects, ["__h1", "__h2"], "left_semi")
    distinct = rows.groupBy(*[named(c) for c in columns]).agg(F.lit(1)).count()
    return total, shapes - shared + distinct, empty


def _comparable(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and missing as one; maps, which do not hash, as sorted entries."""

    def key(c: str) -> Column:
        if isinstance(type_of(df, c), T.MapType):
            return F.sort_array(F.map_entries(named(c)))
        return value(df, c)

    return df.select(*[key(c).alias(c) for c in columns])


def _all_missing(columns: list[str]) -> Column:
    missing = F.lit(True)
    for c in columns:
        missing = missing & named(c).isNull()
    return missing


def _fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of a row; null flags enter too, since hashing skips nulls."""
    values = [named(c) for c in columns]
    missing = [v.isNull() for v in values]
    return [
        F.xxhash64(*values, *missing).alias("__h1"),
        F.xxhash64(F.lit(1), *reversed(values), *missing).alias("__h2"),
    ]


# ---- column level ----


def _share(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


def completeness_from(scan: Mapping[str, dict]) -> dict[str, dict]:
    result = {}
    for column, counts in scan.items():
        missing = counts["rows"] - counts["present"]
        result[column] = {
            "missing_count": missing,
            "missing_pct": _share(missing, counts["rows"]),
            "fully_empty": missing == counts["rows"],
        }
    return result


def column_completeness_checks(df: DataFrame) -> dict[str, dict]:
    return completeness_from(scan_columns(df, ()))


def types_from(df: DataFrame, scan: Mapping[str, dict]) -> dict[str, str]:
    return {c: _type_from(df, c, counts) for c, counts in scan.items()}


def _type_from(df: DataFrame, column: str, counts: Mapping[str, int]) -> str:
    present = counts["present"]
    if present < MIN_VALUES_FOR_TYPE:
        return "string"
    if is_time(df, column):
        return "datetime"
    if isinstance(type_of(df, column), T.BooleanType):
        return "boolean"
    if is_numeric(df, column):
        return "numeric"
    if "numbers" not in counts:
        return "string"
    if counts["numbers"] / present >= NUMERIC_SHARE:
        return "numeric"
    best = max(counts[f"date{i}"] for i in range(len(dates.INFERENCE_FORMATS)))
    return "datetime" if best / present >= DATETIME_SHARE else "string"


def infer_column_type(df: DataFrame, column: str) -> str:
    return types_from(df, scan_columns(df, (TYPES,), [column]))[column]


def infer_all_column_types(df: DataFrame) -> dict[str, str]:
    return types_from(df, scan_columns(df, (TYPES,)))


def parsing_from(
    scan: Mapping[str, dict], column_types: Mapping[str, str], fallback: str = "best"
) -> dict[str, dict]:
    """Values that do not parse as the column's logical type.

    Dates count against the first format most values fit. Where none reaches
    that share, the best format counts, or the last one with ``fallback="last"``.
    """
    result = {}
    for column, counts in scan.items():
        if "numbers" not in counts or not counts["present"]:
            continue
        present = counts["present"]
        if column_types[column] == "numeric" and counts["numbers"] < present:
            result[column] = {"numeric_parse_failures": present - counts["numbers"]}
        elif column_types[column] == "datetime":
            fits = [counts[f"date{i}"] for i in range(len(dates.INFERENCE_FORMATS))]
            other = max(fits) if fallback == "best" else fits[-1]
            fit = next((n for n in fits if n / present >= DATETIME_CHOICE_SHARE), other)
            if fit < present:
                result[column] = {"datetime_parse_failures": present - fit}
    return result


def type_parsing_checks(
    df: DataFrame, column_types: Mapping[str, str], fallback: str = "best"
) -> dict[str, dict]:
    return parsing_from(scan_columns(df, (TYPES,)), column_types, fallback)


def strings_from(scan: Mapping[str, dict], sides: str = "both") -> dict[str, dict]:
    result = {}
    for column, counts in scan.items():
        if "blank" not in counts or not counts["present"]:
            continue
        issues: dict[str, object] = {}
        spaces = counts["spaces"] if sides == "both" else counts["leading"]
        if spaces:
            issues["leading_trailing_spaces"] = spaces
        low, high = CASE_SHARE
        if all(low < counts[k] / counts["present"] < high for k in ("lower", "upper")):
            issues["mixed_casing"] = True
        if counts["blank"]:
            issues["empty_strings"] = counts["blank"]
        if issues:
            result[column] = issues
    return result


def string_quality_checks(df: DataFrame, sides: str = "both") -> dict[str, dict]:
    wants = (CONTENT, LEADING) if sides == "leading" else (CONTENT,)
    return strings_from(scan_columns(df, wants, text_columns(df)), sides)


def validity_from(scan: Mapping[str, dict]) -> dict[str, dict]:
    result = {}
    for column, counts in scan.items():
        if "negative" not in counts:
            continue
        issues: dict[str, object] = {}
        if counts["negative"]:
            issues["negative_values"] = counts["negative"]
        if counts["present"] and counts["low"] == counts["high"]:
            issues["constant_column"] = True
        if issues:
            result[column] = issues
    return result


def numeric_validity_checks(df: DataFrame) -> dict[str, dict]:
    return validity_from(scan_columns(df, (CONTENT,), numeric_columns(df)))


def outlier_fences(
    df: DataFrame, columns: Iterable[str], present: Mapping[str, int] | None = None
) -> dict[str, dict]:
    quartiles = stats.exact_quantiles(df, {c: [0.25, 0.75] for c in columns}, present)
    return {c: iqr_fences(q[0.25], q[0.75]) for c, q in quartiles.items()}


def outlier_checks(df: DataFrame, present: Mapping[str, int] | None = None) -> dict[str, dict]:
    """Values beyond 1.5 interquartile ranges, in numeric columns with enough values."""
    columns = numeric_columns(df)
    if present is None:
        present = {c: s["present"] for c, s in scan_columns(df, (), columns).items()}
    columns = [c for c in columns if present[c] >= MIN_VALUES_FOR_OUTLIERS]
    if not columns:
        return {}
    fences = outlier_fences(df, columns, present)
    x = {c: value(df, c).cast("double") for c in columns}
    beyond = {c: (x[c] < fences[c]["lower"]) | (x[c] > fences[c]["upper"]) for c in columns}
    found = {}
    for chunk in chunked(columns, COLUMNS_PER_SCAN):
        row = df.agg(*[count_where(beyond[c]) for c in chunk]).first()
        for c, n in zip(chunk, row):
            if n:
                found[c] = {"outlier_count": n, "outlier_pct": _share(n, present[c])}
    return found
