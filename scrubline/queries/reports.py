"""Queries of the checks, reports, suggestions, diffs and step chains.

One SQL text derives the whole quality report of a messy table step by step;
each oracle selects its part.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scrubline import operators as ops
from scrubline.functions import stats
from scrubline.operators import checks, diff
from scrubline.plans import profile, recipe, report, suggest
from scrubline.queries.base import (
    CUSTOMERS, DATED, EVENTS, LINES, MESSY, MESSY_ORDERED, ORDERS, TEXTS, TYPED, query, shown_edges, view,
)
from scrubline.queries.cleaning import rounded

# ---- the report in SQL ----

_COLUMN_TYPES = {
    "status": "string", "price": "numeric", "placed": "datetime", "amount": "numeric",
    "constant": "numeric",
}
_KEYS = ", ".join(_COLUMN_TYPES)
_DATE = "try_strptime(placed, '%Y-%m-%d')"


def _row(check, column, metric, value, flag="NULL", when="TRUE"):
    name = f"'{column}'" if column else "CAST(NULL AS STRING)"
    return (f"SELECT '{check}' AS \"check\", {name} AS \"column\", '{metric}' AS metric, "
            f"CAST({value} AS DOUBLE) AS value, CAST({flag} AS BOOLEAN) AS flag FROM m WHERE {when}")


_REPORT_ROWS = [
    _row("dataset_level", None, "row_count", "n"),
    _row("dataset_level", None, "column_count", "5"),
    _row("dataset_level", None, "duplicate_rows", "n - n_distinct"),
    _row("dataset_level", None, "fully_empty_rows", "0"),
    *[r for c in _COLUMN_TYPES for r in (
        _row("completeness", c, "missing_count", f"n - n_{c}"),
        _row("completeness", c, "missing_pct", f"ROUND((n - n_{c}) * 100.0 / n, 2)"),
        _row("completeness", c, "fully_empty", "NULL", f"n_{c} = 0"),
    )],
    _row("type_parsing", "placed", "datetime_parse_failures", "n_placed - placed_ok",
         when="n_placed > placed_ok"),
    _row("type_parsing", "amount", "numeric_parse_failures", "n_amount - amount_ok",
         when="n_amount > amount_ok"),
    *[r for c in ("status", "placed", "amount") for r in (
        _row("string_quality", c, "leading_trailing_spaces", f"{c}_spaces", when=f"{c}_spaces > 0"),
        _row("string_quality", c, "mixed_casing", "NULL", "TRUE",
             f"{c}_lower / n_{c} > 0.1 AND {c}_lower / n_{c} < 0.9 AND "
             f"{c}_upper / n_{c} > 0.1 AND {c}_upper / n_{c} < 0.9"),
        _row("string_quality", c, "empty_strings", f"{c}_blank", when=f"{c}_blank > 0"),
    )],
    _row("numeric_validity", "price", "negative_values", "price_negative", when="price_negative > 0"),
    _row("numeric_validity", "constant", "constant_column", "NULL", "TRUE"),
    _row("outliers", "price", "outlier_count", "price_out", when="price_out > 0"),
    _row("outliers", "price", "outlier_pct", "ROUND(price_out * 100.0 / n_price, 2)", when="price_out > 0"),
]

_TEXT_COUNTS = ", ".join(
    f"count(*) FILTER ({c} <> trim({c})) AS {c}_spaces, "
    f"CAST(count(*) FILTER ({c} = lower({c}) AND {c} <> upper({c})) AS DOUBLE) AS {c}_lower, "
    f"CAST(count(*) FILTER ({c} = upper({c}) AND {c} <> lower({c})) AS DOUBLE) AS {c}_upper, "
    f"count(*) FILTER (trim({c}) = '') AS {c}_blank"
    for c in ("status", "placed", "amount")
)

_REPORT = (
    "WITH t AS (SELECT * FROM {t}), "
    "f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT "
    "quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM t)), "
    "m AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_distinct, "
    + ", ".join(f"count({c}) AS n_{c}" for c in _COLUMN_TYPES) + ", "
    f"count({_DATE}) AS placed_ok, count(try_cast(amount AS DOUBLE)) AS amount_ok, {_TEXT_COUNTS}, "
    "count(*) FILTER (price < 0) AS price_negative, "
    "count(*) FILTER (price < (SELECT lo FROM f) OR price > (SELECT hi FROM f)) AS price_out FROM t), "
    "r AS (" + " UNION ALL ".join(_REPORT_ROWS) + "), "
    "k(\"column\", inferred_type, seq) AS (VALUES "
    + ", ".join(f"('{c}', '{k}', {i})" for i, (c, k) in enumerate(_COLUMN_TYPES.items())) + "), "
    "s AS (SELECT k.\"column\", inferred_type, seq, "
    "max(CASE WHEN metric = 'missing_pct' THEN value END) AS missing_pct, "
    "CAST(sum(CASE WHEN metric = 'missing_count' THEN value ELSE 0 END) AS BIGINT) AS missing_count, "
    + ", ".join(
        f"CAST(sum(CASE WHEN \"check\" = '{section}' AND metric <> 'outlier_pct' "
        f"THEN CASE WHEN flag THEN 1 ELSE value END ELSE 0 END) AS BIGINT) AS {name}"
        for section, name in report.ISSUE_SECTIONS.items()
    )
    + " FROM k JOIN r ON k.\"column\" = r.\"column\" GROUP BY ALL), "
    "z AS (SELECT *, missing_count + type_issues + string_issues + numeric_issues + outlier_issues "
    "AS issue_score FROM s), "
    "h AS (SELECT greatest(0, 100 - CAST(floor(sum(CASE WHEN flag AND metric <> 'fully_empty' THEN n "
    "WHEN metric IN ('row_count', 'column_count', 'missing_pct', 'outlier_pct') THEN 0 "
    "ELSE coalesce(value, 0) END) / (max(n) * 5) * 100) AS BIGINT)) AS score FROM r, m), "
    "g AS (SELECT score, CASE WHEN score >= 85 THEN 'Healthy ✅' WHEN score >= 60 "
    "THEN 'Needs Attention ⚠️' ELSE 'High Risk ❌' END AS status FROM h) "
)

_SUMMARY_COLUMNS = (
    "\"column\", inferred_type, missing_pct, missing_count, type_issues, string_issues, "
    "numeric_issues, outlier_issues, issue_score"
)
_SUMMARY = _REPORT + f"SELECT {_SUMMARY_COLUMNS} FROM z"

# ---- checks ----

query("c1_dataset_level", MESSY, _REPORT + "SELECT n AS row_count, CAST(5 AS BIGINT) AS column_count, "
      "n - n_distinct AS duplicate_rows, CAST(0 AS BIGINT) AS fully_empty_rows FROM m")(
    lambda df: df.sparkSession.createDataFrame(
        [tuple(checks.dataset_level_checks(df).values())],
        "row_count bigint, column_count bigint, duplicate_rows bigint, fully_empty_rows bigint"))

query("c1_dataset_level_texts", TEXTS, "SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, "
      "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows, "
      "CAST(0 AS BIGINT) AS fully_empty_rows FROM {t}")(
    lambda df: df.sparkSession.createDataFrame(
        [tuple(checks.dataset_level_checks(df).values())],
        "row_count bigint, column_count bigint, duplicate_rows bigint, fully_empty_rows bigint"))


def _long(df, section, found):
    """One check's findings as (column, metric, value, flag) rows."""
    empty = {s: {} for s in ("completeness", *report.ISSUE_SECTIONS)}
    frame = report.report_frame(df.sparkSession, {**empty, "dataset_level": {}, section: found})
    return frame.drop("check")


def _section(name):
    return _REPORT + f"SELECT \"column\", metric, value, flag FROM r WHERE \"check\" = '{name}'"


query("c2_completeness", MESSY, _section("completeness"))(
    lambda df: _long(df, "completeness", checks.column_completeness_checks(df)))


@query("c3_infer_column_type", DATED,
       f"SELECT CASE WHEN count(placed) < 5 THEN 'string' WHEN count({_DATE}) >= 0.6 * count(placed) "
       "THEN 'datetime' ELSE 'string' END AS inferred_type FROM {t}")
def _infer_one(df):
    kind = checks.infer_column_type(df, "placed")
    return df.sparkSession.createDataFrame([(kind,)], "inferred_type string")


def _types(df):
    found = checks.infer_all_column_types(df)
    return df.sparkSession.createDataFrame(list(found.items()), "column string, inferred_type string")


query("c4_infer_all_types", MESSY, _REPORT + "SELECT \"column\", inferred_type FROM k")(_types)
query("c5_type_parsing", MESSY, _section("type_parsing"))(
    lambda df: _long(df, "type_parsing", checks.type_parsing_checks(df, checks.infer_all_column_types(df))))
query("c6_string_quality", MESSY, _section("string_quality"))(
    lambda df: _long(df, "string_quality", checks.string_quality_checks(df)))
query("c7_numeric_validity", MESSY, _section("numeric_validity"))(
    lambda df: _long(df, "numeric_validity", checks.numeric_validity_checks(df)))
query("c8_outliers", MESSY, _section("outliers"))(
    lambda df: _long(df, "outliers", checks.outlier_checks(df)))


def _per_column(columns, part):
    return " UNION ALL ".join(part.replace("{c}", c) for c in columns)


_LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("c8_outliers_lineitem", LINES,
      "SELECT * FROM (" + _per_column(
          _LINE_COLUMNS,
          "SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR "
          "{c} > q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS outliers FROM {t}, "
          "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})")
      + ") WHERE outliers > 0")(
    lambda df: _long(df, "outliers", checks.outlier_checks(df)).where("metric = 'outlier_count'")
    .select("column", F.col("value").alias("outliers")))


def _quality(df):
    return report.run_quality_checks(df)


query("c9_quality_report", MESSY, _REPORT + "SELECT * FROM r")(
    lambda df: _quality(df).report_frame(df.sparkSession))
query("c10_column_summary", MESSY, _SUMMARY)(lambda df: _quality(df).summary_frame(df.sparkSession))
query("c10_summary_of_report_table", MESSY, _REPORT + "SELECT * EXCLUDE (inferred_type, seq) FROM z")(
    lambda df: report.summarize_report(_quality(df).report_frame(df.sparkSession)))


@query("c11_dataset_health", MESSY, _REPORT + "SELECT score, status FROM g")
def _health(df):
    found = _quality(df).health
    return df.sparkSession.createDataFrame([(found["score"], found["status"])], "score bigint, status string")


_TEXT = (
    _REPORT + "SELECT 'Dataset Health: ' || status || ' (Score: ' || score || '/100)\n"
    "Rows: ' || n || ', Columns: 5\nDuplicate rows: ' || (n - n_distinct) || "
    "coalesce('\nHigh missing data columns: ' || (SELECT string_agg(\"column\", ', ' "
    "ORDER BY issue_score DESC, missing_pct DESC, seq) FROM z WHERE missing_pct > 30), '') || "
    "'\nHighest risk columns: ' || (SELECT string_agg(\"column\", ', ' ORDER BY issue_score DESC, "
    "missing_pct DESC, seq) FROM (SELECT * FROM z ORDER BY issue_score DESC, missing_pct DESC, seq LIMIT 3)) "
    "AS summary FROM g, m"
)
query("c12_executive_summary", MESSY, _TEXT)(
    lambda df: df.sparkSession.createDataFrame([(_quality(df).text,)], "summary string"))

query("f4_high_missing_columns", MESSY, _SUMMARY + " WHERE missing_pct > 30")(
    lambda df: report.high_missing_columns(_quality(df).summary_frame(df.sparkSession)))
query("f4_high_missing_columns_15", MESSY, _SUMMARY + " WHERE missing_pct > 15")(
    lambda df: report.high_missing_columns(_quality(df).summary_frame(df.sparkSession), 15))
query("k1_summary_order", MESSY,
      _REPORT + "SELECT \"column\", CAST(row_number() OVER (ORDER BY issue_score DESC, missing_pct DESC, seq) "
      "AS BIGINT) AS rank FROM z")(
    lambda df: df.sparkSession.createDataFrame(
        [(r["column"], i) for i, r in enumerate(_quality(df).summary, 1)], "column string, rank bigint"))
query("k4_worst_columns", MESSY,
      _SUMMARY + " ORDER BY issue_score DESC, missing_pct DESC, seq LIMIT 3")(
    lambda df: report.worst_columns(_quality(df).summary_frame(df.sparkSession), columns=df.columns))

# ---- profile ----

_QUARTILES = [("25%", 0.25), ("50%", 0.5), ("75%", 0.75)]
query("c14_describe_numeric", EVENTS, " UNION ALL ".join(
    f"SELECT '{s}' AS statistic, ROUND(CAST({e} AS DOUBLE), 6) AS value FROM {{t}}" for s, e in [
        ("count", "count(value)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"),
        ("min", "min(value)"), *[(s, f"quantile_cont(value, {p})") for s, p in _QUARTILES],
        ("max", "max(value)")]))(
    lambda df: rounded(profile.describe_column(df, "value"), "value"))
query("c14_describe_text", EVENTS,
      "WITH v AS (SELECT event_type AS x, count(*) AS n FROM {t} WHERE event_type IS NOT NULL GROUP BY 1), "
      "top AS (SELECT x, n FROM v ORDER BY n DESC, x LIMIT 1) "
      "SELECT 'count' AS statistic, CAST(sum(n) AS STRING) AS value FROM v UNION ALL "
      "SELECT 'unique', CAST(count(*) AS STRING) FROM v UNION ALL SELECT 'top', x FROM top UNION ALL "
      "SELECT 'freq', CAST(n AS STRING) FROM top")(
    lambda df: profile.describe_column(df, "event_type"))

_QUARTERS = (0.25, 0.5, 0.75)
query("c8_quartiles_searched", EVENTS, " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, ROUND(quantile_cont(value, {p}), 6) AS value FROM {{t}}" for p in _QUARTERS))(
    lambda df: rounded(df.sparkSession.createDataFrame(
        list(stats.exact_quantiles(df, {"value": _QUARTERS}, percentile_rows=100, sorted_rows=500)["value"].items()),
        "p double, value double"), "value"))
query("c15_distribution_few", LINES,
      "SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS position, "
      "CAST(l_linenumber AS STRING) AS bucket, count(*) AS count FROM {t} GROUP BY l_linenumber")(
    lambda df: profile.numeric_distribution(df, "l_linenumber"))
_HISTOGRAM = ", ".join(f"lo + (hi - lo) / 20 * {i}" for i in range(1, 20))
query("c15_distribution_binned", EVENTS,
      "WITH b AS (SELECT CAST(len([e FOR e IN [" + _HISTOGRAM + "] IF value > e]) AS INTEGER) AS p "
      "FROM {t}, (SELECT min(value) AS lo, max(value) AS hi FROM {t}) WHERE value IS NOT NULL) "
      "SELECT CAST(i AS INTEGER) AS position, count(p) AS count FROM range(20) r(i) "
      "LEFT JOIN b ON b.p = r.i GROUP BY i")(
    lambda df: profile.numeric_distribution(df, "value").drop("bucket"))
_QUANTITY_BINS = [
    "(0.95, 3.45]", "(3.45, 5.9]", "(5.9, 8.35]", "(8.35, 10.8]", "(10.8, 13.25]", "(13.25, 15.7]",
    "(15.7, 18.15]", "(18.15, 20.6]", "(20.6, 23.05]", "(23.05, 25.5]", "(25.5, 27.95]", "(27.95, 30.4]",
    "(30.4, 32.85]", "(32.85, 35.3]", "(35.3, 37.75]", "(37.75, 40.2]", "(40.2, 42.65]", "(42.65, 45.1]",
    "(45.1, 47.55]", "(47.55, 50.0]",
]
query("c15_distribution_labels_quantity", view("lineitem", "l_quantity"), " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{b}' AS bucket, count(*) AS count FROM {{t}} "
    f"WHERE l_quantity > {b[1:].split(',')[0]} AND l_quantity <= {b[:-1].split(', ')[1]}"
    for i, b in enumerate(_QUANTITY_BINS)))(
    lambda df: profile.numeric_distribution(df, "l_quantity"))
query("c15_distribution_labels", EVENTS,
      shown_edges(20, lower_first=True) + "SELECT CAST(i AS INTEGER) AS position, "
      "'(' || shown[i + 1] || ', ' || shown[i + 2] || ']' AS bucket, count(k) AS count "
      "FROM range(20) r(i), best LEFT JOIN (SELECT len([e FOR e IN (SELECT edges FROM best) IF value > e]) - 1 AS k "
      "FROM {t} WHERE value IS NOT NULL) v ON v.k = i GROUP BY i, shown")(
    lambda df: profile.numeric_distribution(df, "value"))
query("c16_categorical", view("part", "p_type"),
      "SELECT p_type AS value, count(*) AS count FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda df: profile.categorical_distribution(df, "p_type"))

_CORRELATED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("c17_correlation", LINES, " UNION ALL ".join(
    f"SELECT '{a}' AS index, '{b}' AS variable, "
    + ("1.0" if a == b else f"ROUND(corr({min(a, b)}, {max(a, b)}), 6)")
    + " AS value FROM " + ("(SELECT 1)" if a == b else "{t}")
    for a in _CORRELATED for b in _CORRELATED))(
    lambda df: rounded(profile.correlation_matrix(df), "value"))
# So many columns that all pairs come from one scan; every third has gaps.
_MANY = [f"w{i}" for i in range(24)]
_WIDE = view("lineitem", *[
    f"CASE WHEN (l_orderkey + {i} * l_linenumber) % {i + 2} = 0 AND {i} % 3 = 0 THEN NULL ELSE "
    f"l_quantity * {i % 5} + l_tax * {i} - l_extendedprice / {100 * (i + 1)} + l_partkey % {i + 3} END AS w{i}"
    for i in range(24)])
query("c17_correlation_many", _WIDE, "WITH c AS (SELECT "
      + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for n, a in enumerate(_MANY) for b in _MANY[n + 1:])
      + " FROM {t}), m AS (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE v), "
      "p AS (SELECT split_part(pair, '_', 1) AS a, split_part(pair, '_', 2) AS b, ROUND(v, 6) AS value FROM m) "
      "SELECT a AS index, b AS variable, value FROM p UNION ALL SELECT b, a, value FROM p UNION ALL "
      "SELECT a, a, 1.0 FROM (SELECT a FROM p UNION SELECT b FROM p)")(
    lambda df: rounded(profile.correlation_matrix(df), "value"))
query("c18_box_plot", EVENTS,
      "SELECT min(value) AS min, ROUND(quantile_cont(value, 0.25), 6) AS q1, ROUND(median(value), 6) AS median, "
      "ROUND(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM {t}")(
    lambda df: rounded(profile.box_plot_statistics(df, "value"), "q1", "median", "q3"))
query("c19_scatter", LINES, "SELECT l_quantity AS x, l_extendedprice AS y FROM {t}")(
    lambda df: profile.scatter_data(df, "l_quantity", "l_extendedprice"))

_STATS = ", ".join([
    "ROUND(avg({c}), 6) AS mean", "ROUND(median({c}), 6) AS median",
    "(SELECT CAST({c} AS DOUBLE) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode",
    "ROUND(stddev_samp({c}), 6) AS std", "CAST(min({c}) AS DOUBLE) AS min", "CAST(max({c}) AS DOUBLE) AS max",
    "ROUND(quantile_cont({c}, 0.25), 6) AS q1", "ROUND(quantile_cont({c}, 0.75), 6) AS q3"])
query("c20_column_statistics", LINES, _per_column(
    ("l_quantity", "l_extendedprice", "l_discount"), "SELECT '{c}' AS \"column\", " + _STATS + " FROM {t}"))(
    lambda df: rounded(
        profile.column_statistics(df, ["l_quantity", "l_extendedprice", "l_discount"]),
        "mean", "median", "std", "q1", "q3"))

# ---- diff: balances before and after negatives are replaced ----

_AFTER = "CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END"


def _before_after(df):
    changed = ops.trim_spaces(ops.replace_negative_values(df, "c_acctbal"), "c_mktsegment")
    return df, changed


_SEGMENT_AFTER = "nullif(trim(c_mktsegment), '')"
_CELLS = (f"SELECT c_custkey, c_name, {_SEGMENT_AFTER} IS DISTINCT FROM c_mktsegment AS seg, "
          f"{_AFTER} IS DISTINCT FROM c_acctbal AS bal, c_mktsegment, {_SEGMENT_AFTER} AS new_segment, "
          f"c_acctbal, {_AFTER} AS new_balance FROM {{t}}")

query("x1_diff_mask", CUSTOMERS,
      f"SELECT c_custkey, FALSE AS c_name, seg AS c_mktsegment, bal AS c_acctbal FROM ({_CELLS})")(
    lambda df: diff.diff_mask(*_before_after(df), key="c_custkey"))

_CHANGES_SCHEMA = ("total_cells_changed bigint, rows_affected bigint, columns_affected string, "
                   "rows_added bigint, rows_removed bigint, shape_changed boolean")
_COUNTED = (
    "SELECT CAST(count(*) FILTER (seg) + count(*) FILTER (bal) AS BIGINT) AS total_cells_changed, "
    "count(*) FILTER (seg OR bal) AS rows_affected, 'c_mktsegment,c_acctbal' AS columns_affected, "
    f"CAST(0 AS BIGINT) AS rows_added, CAST(0 AS BIGINT) AS rows_removed, FALSE AS shape_changed FROM ({_CELLS})"
)


def _changes_row(spark, found):
    return spark.createDataFrame(
        [(found["total_cells_changed"], found["rows_affected"], ",".join(found["columns_affected"]),
          found["rows_added"], found["rows_removed"], found["shape_changed"])], _CHANGES_SCHEMA)


query("x2_count_changes", CUSTOMERS, _COUNTED)(
    lambda df: _changes_row(df.sparkSession, diff.count_changes(*_before_after(df), key="c_custkey")))
query("x2_count_changes_shape", CUSTOMERS,
      "SELECT CAST(NULL AS BIGINT) AS total_cells_changed, CAST(NULL AS BIGINT) AS rows_affected, "
      "'' AS columns_affected, CAST(0 AS BIGINT) AS rows_added, count(*) FILTER (c_name IS NULL) AS rows_removed, "
      "TRUE AS shape_changed FROM {t}")(
    lambda df: _changes_row(df.sparkSession, diff.count_changes(
        df, ops.drop_rows_with_nulls(df, "c_name"), key="c_custkey")))


@query("x3_affected_rows", CUSTOMERS,
       f"WITH c AS (SELECT * FROM ({_CELLS}) WHERE seg OR bal ORDER BY c_custkey LIMIT 10) "
       "SELECT 'before' AS side, c_custkey, c_name, c_mktsegment, c_acctbal FROM c UNION ALL "
       "SELECT 'after', c_custkey, c_name, new_segment, new_balance FROM c")
def _affected(df):
    before, after = diff.affected_rows(*_before_after(df), key="c_custkey", limit=10)
    named = [b.select(F.lit(s).alias("side"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
             for s, b in (("before", before), ("after", after))]
    return named[0].unionByName(named[1])


@query("x4_column_changes", CUSTOMERS,
       "SELECT count(*) FILTER (seg AND c_mktsegment IS NOT NULL AND new_segment IS NOT NULL) AS values_changed, "
       "count(*) FILTER (c_mktsegment IS NULL AND new_segment IS NOT NULL) AS nulls_filled, "
       "count(*) FILTER (c_mktsegment IS NOT NULL AND new_segment IS NULL) AS nulls_created, "
       f"count(*) FILTER (seg) AS total_changes FROM ({_CELLS})")
def _column_changes(df):
    found = diff.column_changes(*_before_after(df), "c_mktsegment", key="c_custkey")
    names = ("values_changed", "nulls_filled", "nulls_created", "total_changes")
    return df.sparkSession.createDataFrame(
        [tuple(found[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


query("x5_diff_summary", CUSTOMERS,
      "SELECT '✏️ ' || rows_affected || ' rows modified | 📊 ' || total_cells_changed || "
      f"' cells changed | 📋 Columns: c_mktsegment, c_acctbal' AS summary FROM ({_COUNTED})")(
    lambda df: df.sparkSession.createDataFrame(
        [(diff.format_diff_summary(diff.count_changes(*_before_after(df), key="c_custkey")),)],
        "summary string"))


@query("x6_preview_joined", EVENTS,
       "SELECT TRUE AS success, count(*) AS rows_affected FROM (SELECT value, "
       "last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS before FROM {t}) "
       "WHERE value IS NULL AND before IS NOT NULL")
def _preview_joined(df):
    step = {"tool_name": "fill_nulls", "arguments": {"column": "value", "method": "ffill", "order_by": "event_id"}}
    found = recipe.preview_step(df, step, {"value": "numeric"}, key="event_id")
    return df.sparkSession.createDataFrame(
        [(found["success"], found["changes"]["rows_affected"])], "success boolean, rows_affected bigint")


@query("x6_preview", CUSTOMERS,
       "SELECT TRUE AS success, count(*) FILTER (bal) AS rows_affected, "
       "'✏️ ' || count(*) FILTER (bal) || ' rows modified | 📊 ' || count(*) FILTER (bal) || "
       f"' cells changed | 📋 Columns: c_acctbal' AS summary FROM ({_CELLS})")
def _preview(df):
    step = {"tool_name": "replace_negative_values",
            "arguments": {"column": "c_acctbal", "replacement_value": 0}}
    found = recipe.preview_step(df, step, {"c_acctbal": "numeric"}, key="c_custkey")
    return df.sparkSession.createDataFrame(
        [(found["success"], found["changes"]["rows_affected"], found["summary"])],
        "success boolean, rows_affected bigint, summary string")


# ---- suggestions ----


def _suggested(df):
    return suggest.suggestions_frame(df.sparkSession, suggest.generate_suggestions(_quality(df).report))


def _arguments(**given):
    return "'" + json.dumps(given).replace("'", "''") + "'"


def _rule(section, column, metric, tool, arguments, text, impact, priority, category, when="TRUE"):
    return (f"SELECT '{tool}' AS tool_name, {arguments} AS arguments, {text} AS description, "
            f"CAST({impact} AS BIGINT) AS impact_score, {priority} AS priority, '{category}' AS category "
            f"FROM r, m WHERE \"check\" = '{section}' AND metric = '{metric}' AND "
            f"coalesce(\"column\", '') = '{column}' AND (value > 0 OR flag) AND {when}")


def _graded(percent, high, medium):
    return f"CASE WHEN {percent} > {high} THEN 'high' WHEN {percent} > {medium} THEN 'medium' ELSE 'low' END"


_N = "' || CAST(value AS BIGINT) || '"


def _fill_rule(column, method, words):
    share = f"(SELECT missing_pct FROM s WHERE \"column\" = '{column}')"
    return _rule("completeness", column, "missing_count", "fill_nulls",
                 _arguments(column=column, method=method),
                 f"'{_N} rows lack {words}'",
                 "value", _graded(share, 20, 5), "missing")


_SUGGESTIONS = _REPORT + ", q AS (" + " UNION ALL ".join([
    _rule("dataset_level", "", "duplicate_rows", "deduplicate_rows", _arguments(keep="first"),
          f"'{_N} rows repeat an earlier one: keep the first of each'", "value", "'high'", "duplicates"),
    _fill_rule("status", "mode", "''status'': put in its most frequent value"),
    _fill_rule("price", "median", "''price'': put in its median"),
    _fill_rule("placed", "ffill", "a date in ''placed'': carry the one before on"),
    _fill_rule("amount", "median", "''amount'': put in its median"),
    _rule("string_quality", "status", "leading_trailing_spaces", "trim_spaces", _arguments(column="status"),
          f"'{_N} values of ''status'' begin or end with white space: trim them'", "value", "'medium'", "formatting"),
    _rule("string_quality", "status", "mixed_casing", "standardize_case",
          _arguments(column="status", case="title"),
          "'''status'' mixes letter cases: write it in title case'", "n", "'low'", "formatting"),
    _rule("string_quality", "status", "empty_strings", "trim_spaces", _arguments(column="status"),
          f"'{_N} values of ''status'' are blank: count them as missing and fill them'", "value", "'medium'", "missing",
          "status_blank > status_spaces"),
    _rule("string_quality", "status", "empty_strings", "fill_nulls",
          _arguments(column="status", method="mode"),
          f"'{_N} values of ''status'' are blank: count them as missing and fill them'", "value", "'medium'", "missing"),
    _rule("outliers", "price", "outlier_count", "remove_outliers",
          _arguments(column="price", method="iqr", action="clip"),
          f"'{_N} values of ''price'' lie far out: pull them back to the fences'", "value",
          _graded("(value * 100.0 / n_price)", 10, 3), "outliers"),
    _rule("numeric_validity", "price", "negative_values", "replace_negative_values",
          _arguments(column="price", replacement_value=0),
          f"'{_N} values of ''price'' are below zero: make them 0'", "value", "'medium'", "outliers"),
    _rule("type_parsing", "placed", "datetime_parse_failures", "convert_to_datetime",
          _arguments(column="placed"),
          f"'{_N} values of ''placed'' are no dates: convert the column to time stamps'", "value", "'medium'", "type"),
    _rule("type_parsing", "amount", "numeric_parse_failures", "convert_column_type",
          _arguments(column="amount", target_type="numeric"),
          f"'{_N} values of ''amount'' are no numbers: convert the column, they become null'", "value", "'medium'", "type"),
]) + ") "

query("g1_suggestions", MESSY, _SUGGESTIONS + "SELECT * FROM q")(lambda df: _suggested(df).drop("seq"))
_PRIORITY = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
query("k2_rank_suggestions", MESSY,
      _SUGGESTIONS + f"SELECT priority, impact_score, row_number() OVER (ORDER BY {_PRIORITY}, "
      "impact_score DESC) AS rank FROM q")(
    lambda df: df.sparkSession.createDataFrame(
        [(r["priority"], r["impact_score"], i)
         for i, r in enumerate(suggest.rank_frame(_suggested(df)).collect(), 1)],
        "priority string, impact_score bigint, rank bigint"))
query("k3_top_suggestions", MESSY,
      _SUGGESTIONS + f"SELECT priority, impact_score FROM q ORDER BY {_PRIORITY}, impact_score DESC LIMIT 5")(
    lambda df: suggest.top_frame(_suggested(df)).select("priority", "impact_score"))
query("f3_suggestions_by_category", MESSY, _SUGGESTIONS + "SELECT * FROM q WHERE category = 'missing'")(
    lambda df: suggest.category_frame(_suggested(df), "missing").drop("seq"))
query("c13_suggestion_summary", MESSY, _SUGGESTIONS + "SELECT category, count(*) AS count FROM q GROUP BY 1")(
    lambda df: suggest.category_counts(_suggested(df)))

# ---- steps ----

_TRIM = {"tool_name": "trim_spaces", "arguments": {"column": "c_mktsegment"}}
_UPPER = {"tool_name": "standardize_case", "arguments": {"column": "c_mktsegment", "case": "upper"}}
_NEGATIVES = {"tool_name": "replace_negative_values", "arguments": {"column": "c_acctbal"}}
_BROKEN = {"tool_name": "round_numeric",
           "arguments": {"column": "c_name", "decimals": 1, "method": "round"}}
_STEP_TYPES = {"c_custkey": "numeric", "c_name": "string", "c_mktsegment": "string", "c_acctbal": "numeric"}

query("g2_execute_tool", CUSTOMERS,
      f"SELECT c_custkey, c_name, {_SEGMENT_AFTER} AS c_mktsegment, c_acctbal FROM {{t}}")(
    lambda df: recipe.execute_tool(df, _TRIM, checks.infer_all_column_types(df)))
query("g3_all_keyword", CUSTOMERS,
      f"SELECT c_custkey, nullif(trim(c_name), '') AS c_name, {_SEGMENT_AFTER} AS c_mktsegment, c_acctbal FROM {{t}}")(
    lambda df: recipe.execute_tool(df, {"tool_name": "trim_spaces_batch", "arguments": {"columns": ["all"]}}))
query("g7_apply_skip_errors", CUSTOMERS,
      f"SELECT c_custkey, c_name, upper({_SEGMENT_AFTER}) AS c_mktsegment, {_AFTER} AS c_acctbal FROM {{t}}")(
    lambda df: recipe.apply_steps(df, [_TRIM, _BROKEN, _UPPER, _NEGATIVES], _STEP_TYPES, "skip")[0])
query("g7_apply_stop_on_error", CUSTOMERS,
      f"SELECT c_custkey, c_name, {_SEGMENT_AFTER} AS c_mktsegment, c_acctbal FROM {{t}}")(
    lambda df: recipe.apply_steps(df, [_TRIM, _BROKEN, _UPPER, _NEGATIVES], _STEP_TYPES, "stop")[0])
query("g8_undo", CUSTOMERS,
      f"SELECT c_custkey, c_name, {_SEGMENT_AFTER} AS c_mktsegment, c_acctbal FROM {{t}}")(
    lambda df: recipe.CleaningLog(df, _STEP_TYPES).apply(_TRIM).apply(_UPPER, _NEGATIVES).undo().df)


@query("g9_replay_script", CUSTOMERS,
       f"SELECT c_custkey, c_name, upper({_SEGMENT_AFTER}) AS c_mktsegment, {_AFTER} AS c_acctbal FROM {{t}}")
def _replayed(df):
    script = recipe.CleaningLog(df, _STEP_TYPES).apply(_TRIM, _UPPER, _NEGATIVES).script()
    space: dict = {}
    exec(script, space)  # the script was generated one line above
    return space["clean_dataset"](df)


@query("g5_g6_audit_log", MESSY_ORDERED, _SUGGESTIONS.replace("{t}", MESSY.sql) + "SELECT CAST(row_number() OVER (ORDER BY impact_score DESC) AS INTEGER) "
       "AS seq, tool_name, arguments, CASE tool_name WHEN 'convert_to_datetime' "
       "THEN 'Read ''placed'' as time stamps in format auto.' "
       "ELSE 'Turn ''amount'' into numeric values.' END AS description FROM q WHERE category = 'type'")
def _audit_log(df):
    found = suggest.suggestions_by_category(
        suggest.generate_suggestions(_quality(df).report), "type")
    steps = [{"tool_name": s["tool_name"], "arguments": s["arguments"]} for s in found]
    log = recipe.CleaningLog(df, checks.infer_all_column_types(df)).apply(*steps, on_error="skip")
    return log.frame(df.sparkSession)


@query("y7_type_override", TYPED,
       "SELECT o_orderkey, CASE WHEN amount LIKE '%d' THEN NULL ELSE try_cast(trim(amount) AS DOUBLE) END "
       "AS amount, flag, o_orderstatus, o_totalprice FROM {t}")
def _override(df):
    return recipe.override_type(df, {"amount": "string"}, "amount", "numeric")[0]


query("g1_clean_by_suggestions", ORDERS,
      "WITH b AS (SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM {t})) AS o_custkey, "
      "coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {t})) AS p, o_orderdate, o_orderpriority FROM {t}), "
      "f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(p, 0.25) AS q1, "
      "quantile_cont(p, 0.75) AS q3 FROM b)) "
      "SELECT o_orderkey, o_custkey, ROUND(CASE WHEN p < lo THEN lo WHEN p > hi THEN hi ELSE p END, 6) "
      "AS o_totalprice, o_orderdate, o_orderpriority FROM b, f")(
    lambda df: rounded(recipe.apply_steps(
        df, [*_fills(df), {"tool_name": "remove_outliers",
                           "arguments": {"column": "o_totalprice", "method": "iqr", "action": "clip"}}])[0],
        "o_totalprice"))


def _fills(df):
    """The suggested fills of a table, as steps."""
    found = suggest.suggestions_by_category(
        suggest.generate_suggestions(_quality(df).report), "missing")
    return [{"tool_name": s["tool_name"], "arguments": s["arguments"]} for s in found]
