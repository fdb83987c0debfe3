"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline import operators as ops
from scrubline.queries.base import (
    CUSTOMERS, DATED, EVENTS, LINES, ORDERS, PARTS, TEXTS, TYPED, query, shown_edges, view,
)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- projections ----

query("p1_drop_column", PARTS,
      "SELECT p_partkey, p_name, p_brand, p_type, p_retailprice FROM {t}")(
    lambda df: ops.drop_column(df, "p_size"))

query("p2_drop_columns_batch", PARTS,
      "SELECT p_partkey, p_name, p_brand, p_retailprice FROM {t}")(
    lambda df: ops.drop_columns_batch(df, ["p_size", "p_type", "no_such_column"]))

query("p3_rename_column", PARTS,
      "SELECT p_partkey, p_name AS name, p_brand, p_type, p_size, p_retailprice FROM {t}")(
    lambda df: ops.rename_column(df, "p_name", "name"))

query("p4_reorder_columns", PARTS,
      "SELECT p_size, p_name, p_partkey, p_brand, p_type, p_retailprice FROM {t}")(
    lambda df: ops.reorder_columns(df, ["p_size", "p_name"]))

query("p5_calculated_column", LINES,
      "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
      "CASE WHEN l_discount = 0 THEN NULL "
      "ELSE ROUND(l_extendedprice * (1 - l_discount) / l_discount, 4) END AS net FROM {t}")(
    lambda df: ops.create_calculated_column(
        df, "net", "round(l_extendedprice * (1 - l_discount) / l_discount, 4)"))

# One query per group of formula operators; % and // round down, what cannot be said is missing.
_FORMULA_VIEW = view("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag",
                     "l_orderkey % 13 - 6 AS a", "CAST(l_linenumber AS BIGINT) % 4 - 2 AS b",
                     "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS net")
_FORMULAS = {
    "power": {"a ** 2 + a ** 3": "a * a + a * a * a", "l_quantity ** 2 / 3": "power(l_quantity, 2) / 3"},
    "floor_divide": {"a // b": "CASE WHEN b <> 0 THEN CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) END",
                     "l_quantity // 7": "floor(l_quantity / 7)"},
    "remainder": {"a % b": "CASE WHEN b <> 0 THEN a - b * CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) END",
                  "l_quantity % 7": "l_quantity - 7 * floor(l_quantity / 7)"},
    "compare": {"-3 <= a < b": "-3 <= a AND a < b", "l_returnflag == 'R'": "l_returnflag = 'R'",
                "l_returnflag in ['A', 'N']": "l_returnflag IN ('A', 'N')", "a != b": "a <> b"},
    "logic": {"not (a > 0 and b > 0) or l_tax > 0.05": "NOT (a > 0 AND b > 0) OR l_tax > 0.05",
              "a > 0 & l_returnflag == 'R' | b < 0": "(a > 0 AND l_returnflag = 'R') OR b < 0"},
    "names": {"`net price` * (1 + l_tax)": "net * (1 + l_tax)",
              "abs(a) + length(l_returnflag)": "abs(a) + length(l_returnflag)",
              "`net price` / a": "CASE WHEN a <> 0 THEN net / a END"},
}
_TO_ROUND = ("l_quantity ** 2 / 3", "`net price` * (1 + l_tax)", "`net price` / a")
for _name, _pairs in _FORMULAS.items():
    _sql = ", ".join(
        f"{f'ROUND({sql}, 6)' if formula in _TO_ROUND else sql} AS z{i}" for i, (formula, sql) in enumerate(_pairs.items())
    )

    @query(f"p5_formula_{_name}", _FORMULA_VIEW, f"SELECT l_orderkey, l_linenumber, {_sql} FROM {{t}}")
    def _formulas(df, formulas=tuple(_pairs)):
        df = ops.rename_column(df, "net", "net price")
        for i, formula in enumerate(formulas):
            df = ops.create_calculated_column(df, f"z{i}", formula)
            df = rounded(df, f"z{i}") if formula in _TO_ROUND else df
        return df.select("l_orderkey", "l_linenumber", *[f"z{i}" for i in range(len(formulas))])

query("p6_split_column", PARTS,
      "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, "
      "nullif(split_part(p_name, ' ', 1), '') AS first_word, "
      "nullif(split_part(p_name, ' ', 2), '') AS second_word, "
      "nullif(split_part(p_name, ' ', 3), '') AS third_word FROM {t}")(
    lambda df: ops.split_column(df, "p_name", " ", ["first_word", "second_word", "third_word"]))

query("p7_merge_columns", CUSTOMERS,
      "SELECT c_custkey, c_acctbal, nullif(concat_ws('-', c_name, c_mktsegment), '') AS label FROM {t}")(
    lambda df: ops.merge_columns(df, ["c_name", "c_mktsegment"], "-", "label"))

# ---- filters ----

query("f1_drop_rows_with_nulls", EVENTS, "SELECT * FROM {t} WHERE value IS NOT NULL")(
    lambda df: ops.drop_rows_with_nulls(df, "value"))

_FENCES = (
    "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {t}))"
)

query("f2_drop_outliers", EVENTS,
      "SELECT t.* FROM {t} t, " + _FENCES + " f WHERE NOT coalesce(value < lo OR value > hi, FALSE)")(
    lambda df: ops.remove_outliers(df, "value", "iqr", "drop"))

query("f5_duplicate_probe", TEXTS,
      "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM "
      "(SELECT count(*) AS n FROM {t} GROUP BY text, lang)")(
    lambda df: ops.duplicate_count(df, ["text", "lang"]))

# ---- missing values ----

for _method, _sql in [("mean", "avg(value)"), ("median", "median(value)")]:
    query(f"m1_fill_{_method}", EVENTS,
          "SELECT event_id, ts, user_id, event_type, "
          f"ROUND(coalesce(value, (SELECT {_sql} FROM {{t}})), 6) AS value FROM {{t}}")(
        lambda df, m=_method: rounded(ops.fill_nulls(df, "value", m), "value"))

query("m2_fill_mode", EVENTS,
      "SELECT event_id, ts, user_id, value, coalesce(event_type, (SELECT event_type FROM {t} "
      "WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) "
      "AS event_type FROM {t}")(
    lambda df: ops.fill_nulls(df, "event_type", "mode"))

query("m3_fill_zero", EVENTS,
      "SELECT event_id, ts, user_id, coalesce(value, 0.0) AS value, event_type FROM {t}")(
    lambda df: ops.fill_nulls(df, "value", "zero"))

_FORWARD = ("last_value({0} IGNORE NULLS) OVER (ORDER BY event_id "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}")
_BACKWARD = ("first_value({0} IGNORE NULLS) OVER (ORDER BY event_id "
             "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {0}")

query("m4_fill_forward", EVENTS,
      f"SELECT event_id, ts, user_id, {_FORWARD.format('value')}, event_type FROM {{t}}")(
    lambda df: ops.fill_nulls(df, "value", "ffill", order_by="event_id"))

query("m4_fill_backward", EVENTS,
      f"SELECT event_id, ts, user_id, value, {_BACKWARD.format('event_type')} FROM {{t}}")(
    lambda df: ops.fill_nulls(df, "event_type", "bfill", order_by="event_id"))

query("w1_forward_fill", EVENTS,
      f"SELECT event_id, ts, user_id, {_FORWARD.format('value')}, {_FORWARD.format('event_type')} FROM {{t}}")(
    lambda df: ops.fill_nulls_batch(df, ["value", "event_type"], "ffill", order_by="event_id"))

# The first rows have no order key, so they come first; each other row keeps its own.
_KEYLESS = view("events", "event_id", "CASE WHEN event_id < 2 THEN NULL ELSE event_id END AS k",
                "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value")
for _name, _method, _filled_sql in (
    ("w1_forward_fill_null_keys", "ffill", "last_value(value IGNORE NULLS) OVER (ORDER BY k NULLS FIRST "
     "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("w2_backward_fill_null_keys", "bfill", "first_value(value IGNORE NULLS) OVER (ORDER BY k NULLS FIRST "
     "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):
    query(_name, _KEYLESS, f"SELECT * FROM (SELECT event_id, k, {_filled_sql} AS value FROM {{t}}) WHERE k IS NOT NULL")(
        lambda df, m=_method: ops.fill_nulls(df, "value", m, order_by="k").where("k IS NOT NULL"))

query("w2_backward_fill", EVENTS,
      f"SELECT event_id, ts, user_id, {_BACKWARD.format('value')}, {_BACKWARD.format('event_type')} FROM {{t}}")(
    lambda df: ops.fill_nulls_batch(df, ["value", "event_type"], "bfill", order_by="event_id"))

# The same cut into many ranges, as large tables are.
for _name, _method, _filled_sql in (
    ("w1_forward_fill_ranged", "ffill", _FORWARD), ("w2_backward_fill_ranged", "bfill", _BACKWARD),
):
    query(_name, EVENTS,
          f"SELECT event_id, ts, user_id, {_filled_sql.format('value')}, {_filled_sql.format('event_type')} FROM {{t}}")(
        lambda df, m=_method: ops.fill_nulls_batch(
            df, ["value", "event_type"], m, order_by="event_id", rows_per_range=500))

# Order keys that tie and are missing, two of them, and groups: one user has a third of all rows.
_TIED = view("events", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 20 END AS who",
             "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 40 END AS slot", "user_id % 3 AS lane", "event_id",
             "CASE WHEN event_id % 7 < 4 THEN NULL ELSE value END AS value",
             "CASE WHEN event_id % 5 < 3 THEN NULL ELSE event_type END AS event_type")
for _name, _method, _function, _frame in (
    ("w1_forward_fill", "ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"),
    ("w2_backward_fill", "bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"),
):
    for _kind, _by, _within, _ties in (
        ("tied_keys", ["slot"], [], "slot NULLS FIRST, who, lane, event_id"),
        ("two_keys", ["slot", "lane"], [], "slot NULLS FIRST, lane, who, event_id"),
        ("in_groups", ["slot", "lane"], ["who"], "slot NULLS FIRST, lane, event_id"),
    ):
        _over = f"OVER ({'PARTITION BY who ' if _within else ''}ORDER BY {_ties} ROWS BETWEEN {_frame})"
        query(f"{_name}_{_kind}", _TIED,
              "SELECT who, slot, lane, event_id, "
              + ", ".join(f"{_function}({c} IGNORE NULLS) {_over} AS {c}" for c in ("value", "event_type")) + " FROM {t}")(
            lambda df, m=_method, by=_by, within=_within: ops.fill_nulls_batch(
                df, ["value", "event_type"], m, order_by=by, within=within, rows_per_range=700))

query("m5_fill_custom", EVENTS,
      "SELECT event_id, ts, user_id, value, coalesce(event_type, 'unknown') AS event_type FROM {t}")(
    lambda df: ops.fill_nulls(df, "event_type", "custom", "unknown"))

query("m6_fill_batch", ORDERS,
      "SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM {t})) AS o_custkey, "
      "coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {t})) AS o_totalprice, "
      "o_orderdate, o_orderpriority FROM {t}")(
    lambda df: ops.fill_nulls_batch(
        df, ["o_custkey", "o_totalprice", "o_orderpriority", "no_such_column"], "median"))

# ---- duplicate rows ----

for _keep, _order in [("first", "ASC"), ("last", "DESC")]:
    query(f"w3_dedup_keep_{_keep}", TEXTS,
          "SELECT doc_id, text, lang, source FROM (SELECT *, row_number() OVER "
          f"(PARTITION BY text ORDER BY doc_id {_order}) AS rn FROM {{t}}) WHERE rn = 1")(
        lambda df, k=_keep: ops.deduplicate_rows(df, ["text"], k, order_by="doc_id"))

query("w3_dedup_keep_none", TEXTS,
      "SELECT doc_id, text, lang, source FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n "
      "FROM {t}) WHERE n = 1")(
    lambda df: ops.deduplicate_rows(df, ["text"], False))

query("w3_dedup_whole_rows", view("lineitem", "l_orderkey", "l_returnflag", "l_linestatus"),
      "SELECT DISTINCT * FROM {t}")(
    lambda df: ops.deduplicate_rows(df))

query("k5_preview", EVENTS, "SELECT * FROM {t} ORDER BY event_id LIMIT 50")(
    lambda df: ops.preview_rows(df, 50, order_by="event_id"))

# ---- strings ----

_SEGMENT = "SELECT c_custkey, c_name, {0} AS c_mktsegment, c_acctbal FROM {{t}}"


def _segment(expression):
    return _SEGMENT.format(expression)


query("str_trim", CUSTOMERS, _segment("nullif(trim(c_mktsegment), '')"))(
    lambda df: ops.trim_spaces(df, "c_mktsegment"))

query("str_trim_batch", CUSTOMERS,
      "SELECT c_custkey, nullif(trim(c_name), '') AS c_name, "
      "nullif(trim(c_mktsegment), '') AS c_mktsegment, c_acctbal FROM {t}")(
    lambda df: ops.trim_spaces_batch(df, ["c_name", "c_mktsegment", "c_acctbal"]))

_TITLE = (
    "coalesce(list_aggregate([upper(w[1]) || lower(w[2:]) FOR w IN "
    "regexp_extract_all({0}, '([a-zA-Z]+|[^a-zA-Z]+)')], 'string_agg', ''), CASE WHEN {0} = '' THEN '' END)"
)

for _case, _sql in [("lower", "lower({0})"), ("upper", "upper({0})"), ("title", _TITLE)]:
    query(f"str_case_{_case}", CUSTOMERS, _segment(_sql.format("c_mktsegment")))(
        lambda df, c=_case: ops.standardize_case(df, "c_mktsegment", c))

query("str_case_batch", CUSTOMERS,
      f"SELECT c_custkey, {_TITLE.format('c_name')} AS c_name, "
      f"{_TITLE.format('c_mktsegment')} AS c_mktsegment, c_acctbal FROM {{t}}")(
    lambda df: ops.standardize_case_batch(df, ["c_name", "c_mktsegment", "c_acctbal"], "title"))

query("str_replace", TEXTS,
      "SELECT doc_id, nullif(replace(text, 'the', 'THE'), '') AS text, lang, source FROM {t}")(
    lambda df: ops.replace_text(df, "text", "the", "THE"))

query("str_regex", TEXTS,
      "SELECT doc_id, nullif(regexp_replace(text, '([0-9]+)-([0-9]+)', '\\2$\\1', 'g'), '') AS text, "
      "lang, source FROM {t}")(
    lambda df: ops.replace_text_regex(df, "text", r"(?P<low>[0-9]+)-(?P<high>[0-9]+)", r"\g<high>$\1"))

query("str_special", TEXTS,
      "SELECT doc_id, nullif(regexp_replace(text, '[^a-zA-Z0-9\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]', '', 'g'), '') AS text, lang, source FROM {t}")(
    lambda df: ops.remove_special_chars(df, "text"))

_PADS = {
    "left": "CASE WHEN length(c_mktsegment) >= 11 THEN c_mktsegment ELSE lpad(c_mktsegment, 11, '*') END",
    "right": "CASE WHEN length(c_mktsegment) >= 11 THEN c_mktsegment ELSE rpad(c_mktsegment, 11, '*') END",
    "both": "CASE WHEN length(c_mktsegment) >= 11 THEN c_mktsegment ELSE "
            "repeat('*', (11 - length(c_mktsegment)) // 2 + ((11 - length(c_mktsegment)) & 1)) || c_mktsegment || "
            "repeat('*', (11 - length(c_mktsegment)) // 2) END",
}
for _side, _sql in _PADS.items():
    query(f"str_pad_{_side}", CUSTOMERS, _segment(_sql))(
        lambda df, s=_side: ops.pad_string(df, "c_mktsegment", 11, "*", s))

query("str_slice", TEXTS,
      "SELECT doc_id, nullif(CASE WHEN length(text) > 6 THEN substr(text, greatest(length(text) - 40, 0) + 1, "
      "length(text) - 6 - greatest(length(text) - 40, 0)) ELSE '' END, '') AS text, lang, source FROM {t}")(
    lambda df: ops.slice_string(df, "text", -40, -6))

query("str_affix", CUSTOMERS, _segment("'<' || c_mktsegment || '>'"))(
    lambda df: ops.add_prefix_suffix(df, "c_mktsegment", "<", ">"))

# ---- numbers ----


def _line(expression):
    return (f"SELECT l_orderkey, l_linenumber, l_quantity, {expression} AS l_extendedprice, "
            "l_discount, l_tax FROM {t}")


query("n1_round", LINES, _line("round_even(l_extendedprice * 10.0, 0) / 10.0"))(
    lambda df: ops.round_numeric(df, "l_extendedprice", 1))
query("n1_floor", LINES, _line("floor(l_extendedprice * 10.0) / 10.0"))(
    lambda df: ops.round_numeric(df, "l_extendedprice", 1, "floor"))
query("n1_ceil_tens", LINES, _line("ceil(l_extendedprice / 10.0) * 10.0"))(
    lambda df: ops.round_numeric(df, "l_extendedprice", -1, "ceil"))

query("n2_clip", ORDERS,
      "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 THEN 50000.0 "
      "WHEN o_totalprice > 300000 THEN 300000.0 ELSE o_totalprice END AS o_totalprice, "
      "o_orderdate, o_orderpriority FROM {t}")(
    lambda df: ops.clip_numeric(df, "o_totalprice", 50000.0, 300000.0))


def _event(expression, prefix=""):
    return (prefix + f"SELECT event_id, ts, user_id, {expression} AS value, event_type "
            "FROM {t} t")


query("n3_scale_minmax", EVENTS,
      _event("ROUND((value - lo) / (hi - lo), 9)") + ", (SELECT min(value) AS lo, max(value) AS hi FROM {t})")(
    lambda df: rounded(ops.scale_numeric(df, "value", "minmax"), "value", digits=9))
query("n3_scale_zscore", EVENTS,
      _event("ROUND((value - m) / s, 6)") + ", (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {t})")(
    lambda df: rounded(ops.scale_numeric(df, "value", "zscore"), "value"))

_BALANCE = "SELECT c_custkey, c_name, c_mktsegment, {0} AS c_acctbal FROM {{t}}"
for _op, _sql in {
    "abs": "abs(c_acctbal)",
    "sqrt": "CASE WHEN c_acctbal >= 0 THEN ROUND(sqrt(c_acctbal), 6) END",
    "log": "CASE WHEN c_acctbal > 0 THEN ROUND(ln(c_acctbal), 6) "
           "WHEN c_acctbal = 0 THEN CAST('-inf' AS DOUBLE) END",
    "square": "c_acctbal * c_acctbal",
}.items():
    query(f"n4_math_{_op}", CUSTOMERS, _BALANCE.format(_sql))(
        lambda df, o=_op: rounded(ops.apply_math(df, "c_acctbal", o), "c_acctbal")
        if o in ("sqrt", "log") else ops.apply_math(df, "c_acctbal", o))

query("n4_math_square_bigint", view("orders", "o_orderkey", "o_custkey"),
      "SELECT o_orderkey, o_custkey * o_custkey AS o_custkey FROM {t}")(
    lambda df: ops.apply_math(df, "o_custkey", "square"))

_BIN_EDGES = ", ".join(f"lo + (hi - lo) / 12 * {i}" for i in range(1, 12))
query("n5_bin", EVENTS,
      f"SELECT event_id, value, CASE WHEN value IS NOT NULL THEN 'bin' || "
      f"CAST(len([e FOR e IN [{_BIN_EDGES}] IF value > e]) AS STRING) END AS bin "
      "FROM {t}, (SELECT min(value) AS lo, max(value) AS hi FROM {t})")(
    lambda df: ops.bin_numeric(df, "value", 12, [f"bin{i}" for i in range(12)], "bin").select(
        "event_id", "value", "bin"))
query("w3_dedup_documents", view("documents", "text", "lang", "source", "n_chars"),
      "SELECT DISTINCT text, lang, source, n_chars FROM {t}")(lambda df: ops.deduplicate_rows(df))

# Quantities run from 1 to 50 in every table, so their bins are known.
query("n5_bin_labels_quantity", LINES,
      "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= 13.25 THEN '(0.951, 13.25]' "
      "WHEN l_quantity <= 25.5 THEN '(13.25, 25.5]' WHEN l_quantity <= 37.75 THEN '(25.5, 37.75]' "
      "ELSE '(37.75, 50.0]' END AS bin FROM {t}")(
    lambda df: ops.bin_numeric(df, "l_quantity", 4, new_column="bin").select(
        "l_orderkey", "l_linenumber", "l_quantity", "bin"))
query("n5_bin_labels", EVENTS,
      shown_edges(12) + "SELECT event_id, ts, user_id, event_type, value, CASE WHEN value IS NOT NULL THEN "
      "'(' || shown[k] || ', ' || shown[k + 1] || ']' END AS bin "
      "FROM (SELECT *, len([e FOR e IN edges IF value > e]) AS k FROM {t}, best)")(
    lambda df: ops.bin_numeric(df, "value", 12, new_column="bin"))

_ZSTATS = "(SELECT avg(value) AS m, stddev_samp(value) AS s FROM {t})"
query("n6_outliers_iqr_null", EVENTS,
      _event("CASE WHEN value < lo OR value > hi THEN NULL ELSE value END") + ", " + _FENCES)(
    lambda df: ops.remove_outliers(df, "value"))
query("n7_outliers_zscore_null", EVENTS,
      _event("CASE WHEN abs((value - m) / s) > 3 THEN NULL ELSE value END") + ", " + _ZSTATS)(
    lambda df: ops.remove_outliers(df, "value", "zscore"))
query("n7_outliers_zscore_drop", EVENTS,
      _event("value") + ", " + _ZSTATS + " WHERE value IS NULL OR NOT abs((value - m) / s) > 3")(
    lambda df: ops.remove_outliers(df, "value", "zscore", "drop"))
query("n8_outliers_clip", EVENTS,
      _event("ROUND(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6)") + ", " + _FENCES)(
    lambda df: rounded(ops.remove_outliers(df, "value", "iqr", "clip"), "value"))
query("n8_outliers_zscore_clip", EVENTS,
      _event("ROUND(CASE WHEN value < m - 3 * s THEN m - 3 * s WHEN value > m + 3 * s THEN m + 3 * s "
             "ELSE value END, 6)") + ", " + _ZSTATS)(
    lambda df: rounded(ops.remove_outliers(df, "value", "zscore", "clip"), "value"))
query("n8_outliers_replace", EVENTS,
      _event("CASE WHEN value < lo OR value > hi THEN -1.0 ELSE value END") + ", " + _FENCES)(
    lambda df: ops.remove_outliers(df, "value", "iqr", "replace", -1.0))
for _center, _sql in [("mean", "avg"), ("median", "median")]:
    query(f"n8_outliers_{_center}", EVENTS,
          "WITH f AS (SELECT * FROM " + _FENCES + "), "
          "c AS (SELECT " + _sql + "(value) AS center FROM {t}, f WHERE value BETWEEN lo AND hi) "
          + _event("ROUND(CASE WHEN value < lo OR value > hi THEN center ELSE value END, 6)") + ", f, c")(
        lambda df, c=_center: rounded(ops.remove_outliers(df, "value", "iqr", c), "value"))

query("n9_negatives_zero", CUSTOMERS, _BALANCE.format("CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END"))(
    lambda df: ops.replace_negative_values(df, "c_acctbal"))
for _center, _sql in [("mean", "avg"), ("median", "median")]:
    query(f"n9_negatives_{_center}", CUSTOMERS,
          _BALANCE.format("ROUND(CASE WHEN c_acctbal < 0 THEN (SELECT " + _sql + "(c_acctbal) FROM {{t}} "
                          "WHERE c_acctbal >= 0) ELSE c_acctbal END, 6)").replace("{{t}}", "{t}"))(
        lambda df, c=_center: rounded(ops.replace_negative_values(df, "c_acctbal", c), "c_acctbal"))

# ---- dates ----

_PLACED = "try_strptime(placed, '%Y-%m-%d')"

query("dt_convert_format", DATED, f"SELECT o_orderkey, {_PLACED} AS placed, o_orderdate FROM {{t}}")(
    lambda df: ops.convert_to_datetime(df, "placed", "%Y-%m-%d"))
query("dt_convert_guess", DATED, f"SELECT o_orderkey, {_PLACED} AS placed, o_orderdate FROM {{t}}")(
    lambda df: ops.convert_to_datetime(df, "placed", order_by="o_orderkey"))

_ZONED = view(
    "orders",
    "o_orderkey",
    "CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN 'T03:04:05Z' "
    "WHEN 1 THEN 'T03:04:05+02:00' ELSE 'T03:04:05-0130' END AS placed",
)
query("dt_convert_iso_zone", _ZONED,
      "SELECT o_orderkey, CAST(CAST(substr(placed, 1, 10) AS DATE) AS TIMESTAMP) + CASE o_orderkey % 3 "
      "WHEN 0 THEN INTERVAL '3 hours 4 minutes 5 seconds' WHEN 1 THEN INTERVAL '1 hours 4 minutes 5 seconds' "
      "ELSE INTERVAL '4 hours 34 minutes 5 seconds' END AS placed FROM {t}")(
    lambda df: ops.convert_to_datetime(df, "placed", order_by="o_orderkey"))

for _part, _sql in {
    "year": "CAST(year({0}) AS INTEGER)", "month": "CAST(month({0}) AS INTEGER)",
    "day": "CAST(day({0}) AS INTEGER)", "weekday": "dayname({0})",
    "quarter": "CAST(quarter({0}) AS INTEGER)",
}.items():
    query(f"dt_part_{_part}", DATED,
          f"SELECT o_orderkey, placed, o_orderdate, {_sql.format('o_orderdate')} AS part FROM {{t}}")(
        lambda df, p=_part: ops.extract_date_part(df, "o_orderdate", p, "part"))
query("dt_part_of_text", DATED,
      f"SELECT o_orderkey, placed, o_orderdate, dayname({_PLACED}) AS part FROM {{t}}")(
    lambda df: ops.extract_date_part(df, "placed", "weekday", "part", order_by="o_orderkey"))

for _unit, _sql in {
    "days": "INTERVAL 45 DAY", "weeks": "INTERVAL (7 * 45) DAY", "months": "INTERVAL 45 MONTH",
    "years": "INTERVAL 45 YEAR",
}.items():
    query(f"dt_offset_{_unit}", DATED,
          f"SELECT o_orderkey, placed, o_orderdate, o_orderdate + {_sql} AS later FROM {{t}}")(
        lambda df, u=_unit: ops.offset_date(df, "o_orderdate", 45, u, "later"))

_MICROS = "(epoch_us(TIMESTAMP '1998-08-02 12:30:00') - epoch_us(ts))"
_DAYS = f"CAST(floor({_MICROS} / 86400000000.0) AS BIGINT)"
for _unit, _sql in {
    "days": _DAYS, "weeks": f"{_DAYS} / CAST(7 AS DOUBLE)",
    "hours": f"{_MICROS} / CAST(1000000 AS DOUBLE) / CAST(3600 AS DOUBLE)",
    "years": f"{_DAYS} / CAST(365.25 AS DOUBLE)",
}.items():
    query(f"dt_diff_{_unit}", EVENTS, f"SELECT event_id, ts, {_sql} AS gap FROM {{t}}")(
        lambda df, u=_unit: ops.date_difference(
            df, "ts", "1998-08-02 12:30:00", u, "gap").select("event_id", "ts", "gap"))

# ---- types ----

_NUMBER = "CASE WHEN amount LIKE '%d' THEN NULL ELSE try_cast(trim(amount) AS DOUBLE) END"
_TYPED = "SELECT o_orderkey, {0} AS amount, {1} AS flag, o_orderstatus, o_totalprice FROM {{t}}"
_FLAG = ("CASE WHEN lower(trim(flag)) IN ('true','yes','1','1.0','t','y') THEN TRUE "
         "WHEN lower(trim(flag)) IN ('false','no','0','0.0','f','n') THEN FALSE END")

query("y1_to_numeric", TYPED, _TYPED.format(_NUMBER, "flag"))(
    lambda df: ops.convert_column_type(df, "amount", "numeric"))
query("y2_to_string", TYPED,
      "SELECT CAST(o_orderkey AS STRING) AS o_orderkey, amount, flag, o_orderstatus, o_totalprice FROM {t}")(
    lambda df: ops.convert_column_type(df, "o_orderkey", "string"))
query("y3_to_datetime", DATED, f"SELECT o_orderkey, {_PLACED} AS placed, o_orderdate FROM {{t}}")(
    lambda df: ops.convert_column_type(df, "placed", "datetime", order_by="o_orderkey"))
query("y4_to_boolean", TYPED, _TYPED.format("amount", _FLAG))(
    lambda df: ops.convert_column_type(df, "flag", "boolean"))


@query("y5_to_categorical", TYPED,
       "SELECT o_orderstatus AS category, count(*) AS count FROM {t} WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def _categorical(df):
    return ops.category_frame(ops.convert_column_type(df, "o_orderstatus", "categorical"), "o_orderstatus")


@query("y5_many_categories", view("orders", "CAST(o_orderkey AS STRING) AS k", "o_orderstatus"),
       "SELECT k AS category, count(*) AS count FROM {t} WHERE k IS NOT NULL GROUP BY 1")
def _many_categories(df):
    return ops.category_frame(ops.convert_column_type(df, "k", "categorical"), "k")


# Nearly every text is a category of its own; codes follow their order, missing ones are -1.
query("y5_codes", view("documents", "doc_id", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE md5(text) END AS label"),
      "SELECT doc_id, label, CASE WHEN label IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY label NULLS LAST) - 1 END "
      "AS label_code FROM {t}")(
    lambda df: ops.encode_categories(df, "label"))
query("y5_codes_of_numbers", view("events", "event_id", "user_id", "value"),
      "SELECT event_id, user_id, value, dense_rank() OVER (ORDER BY value) - 1 AS value_code FROM {t}")(
    lambda df: ops.encode_categories(df, "value"))


query("y6_convert_batch", TYPED, _TYPED.format(_NUMBER, "try_cast(flag AS DOUBLE)"))(
    lambda df: ops.convert_columns_batch(df, ["amount", "flag", "no_such_column"], "numeric"))
