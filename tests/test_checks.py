import json

import pytest

from scrubline import operators as ops
from scrubline.functions import stats
from scrubline.operators import checks
from scrubline.plans import report


def test_dataset_level(table):
    df = table("id bigint, v string", [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (3, "c"), (4, "d")])
    assert checks.dataset_level_checks(df) == {
        "row_count": 7, "column_count": 2, "duplicate_rows": 3, "fully_empty_rows": 0}


def test_empty_rows_and_nulls_in_copies(table):
    rows = [(None, None), (None, None), (None, "a"), ("a", None), (None, "a"), ("", None)]
    found = checks.dataset_level_checks(table("a string, b string", rows))
    assert found["duplicate_rows"] == 2 and found["fully_empty_rows"] == 2


def test_hot_copies(table):
    rows = [(i % 7 if i % 3 else 1, "x" * (i % 2), None if i % 5 else 0.5) for i in range(900)]
    df = table("a bigint, b string, c double", rows).repartition(4)
    assert checks.dataset_level_checks(df)["duplicate_rows"] == len(rows) - len(set(rows))


def test_no_rows_and_no_columns(table, spark):
    empty = table("a string", [])
    assert checks.column_completeness_checks(empty) == {
        "a": {"missing_count": 0, "missing_pct": 0.0, "fully_empty": True}}
    assert checks.dataset_level_checks(empty)["duplicate_rows"] == 0
    assert checks.dataset_level_checks(spark.range(3).drop("id"))["row_count"] == 0


def test_completeness(table):
    df = table("n double, s string, e string, k bigint",
               [(None if i < 3 else float(i), "a" if i % 3 else None, None, i) for i in range(9)])
    found = checks.column_completeness_checks(df)
    assert found["n"] == {"missing_count": 3, "missing_pct": 33.33, "fully_empty": False}
    assert found["e"]["fully_empty"] and found["k"]["missing_count"] == 0


def test_nan_is_missing_and_blank_is_not(table):
    df = table("x double, s string", [(float("nan"), ""), (1.0, " ")])
    found = checks.column_completeness_checks(df)
    assert found["x"]["missing_count"] == 1 and found["s"]["missing_count"] == 0


ISO = ["2023-01-01", "2023-01-02", "2023-01-03", "2023-01-04", "2023-01-05"]


@pytest.mark.parametrize(
    "given, want",
    [
        (["1", "2", "3", "4", "5", "6", "7", "8", "abc", "def"], "numeric"),
        (["1", "2", "3", "4", "5", "6", "7", "x", "abc", "def"], "string"),
        (["a", "b", None, None, None], "string"),
        (["1", "2", "3", "4", None], "string"),
        (ISO, "datetime"),
        (["12/31/2023"] * 5, "datetime"),
        (["31-12-2023"] * 5, "datetime"),
        (["2023/12/31"] * 5, "datetime"),
        (ISO[:3] + ["bad", "worse"], "datetime"),
        (ISO[:2] + ["bad", "worse", "12/31/2023"], "string"),
        (["nan", "nan", "1", "2", "3", "4"], "string"),
        (["1e5", " 2 ", "-3.", ".4", "inf"], "numeric"),
        ([None] * 6, "string"),
    ],
)
def test_inference_from_text(table, given, want):
    assert checks.infer_column_type(table("s string", given), "s") == want


def test_inference_from_physical_types(spark):
    df = spark.range(10).selectExpr(
        "id", "id > 3 as b", "cast('2024-01-01' as timestamp_ntz) as t", "date'2024-01-01' as d",
        "array(id) as l", "cast(id as decimal(10, 2)) as m", "if(id < 3, true, null) as few")
    assert checks.infer_all_column_types(df) == {
        "id": "numeric", "b": "boolean", "t": "datetime", "d": "datetime", "l": "string",
        "m": "numeric", "few": "string"}


def test_parse_failures(table):
    rows = [(str(i), d) for i, d in enumerate(ISO * 2)]
    rows[3] = ("oops", "bad")
    rows[7] = ("7", "worse")
    df = table("n string, d string", rows)
    types = checks.infer_all_column_types(df)
    assert checks.type_parsing_checks(df, types) == {
        "n": {"numeric_parse_failures": 1}, "d": {"datetime_parse_failures": 2}}


def test_parse_failures_against_the_best_or_the_last_format(table):
    df = table("d string", [*ISO[:3], "bad", "2023/01/01"])
    types = {"d": "datetime"}
    assert checks.type_parsing_checks(df, types)["d"]["datetime_parse_failures"] == 2
    assert checks.type_parsing_checks(df, types, fallback="last")["d"]["datetime_parse_failures"] == 4


def test_string_quality(table):
    rows = list(zip(
        ["Alice", "Bob", "Charlie", "David", "Eve"],
        [" hello ", "  world", "test  ", " data ", "quality"],
        ["hello", "WORLD", "test", "HELLO", "World"],
        ["a", "", "   ", "b", ""],
    ))
    df = table("clean string, spaces string, mixed string, empty string", rows)
    found = checks.string_quality_checks(df)
    assert found == {
        "spaces": {"leading_trailing_spaces": 4},
        "mixed": {"mixed_casing": True},
        "empty": {"leading_trailing_spaces": 1, "empty_strings": 3},
    }
    assert checks.string_quality_checks(df, sides="leading")["spaces"]["leading_trailing_spaces"] == 3


def test_mixed_casing(table):
    words = ["hello", "WORLD", "test", "HELLO", "World", "lowercase", "UPPERCASE", "Mixed", "case", "TEST"]
    assert checks.string_quality_checks(table("s string", words)) == {"s": {"mixed_casing": True}}
    assert checks.string_quality_checks(table("s string", ["a"] * 9 + ["B"])) == {}


def test_numeric_validity(table):
    df = table("p bigint, n bigint, k bigint, x double",
               [(i, -i if i % 2 else i, 5, float("nan")) for i in range(1, 11)])
    assert checks.numeric_validity_checks(df) == {
        "n": {"negative_values": 5}, "k": {"constant_column": True}}


def test_outliers(table):
    df = table("o bigint, s bigint", [(i if i < 9 else 1000, i if i < 5 else None) for i in range(10)])
    assert checks.outlier_checks(df) == {"o": {"outlier_count": 1, "outlier_pct": 10.0}}


def test_many_columns_take_several_scans(table, monkeypatch):
    monkeypatch.setattr(checks, "COLUMNS_PER_SCAN", 3)
    monkeypatch.setattr(stats, "COLUMNS_PER_SCAN", 2)
    names = [f"c{i}" for i in range(8)]
    df = table(", ".join(f"{n} string" for n in names), [tuple(" 1" for _ in names)] * 5)
    assert set(checks.string_quality_checks(df)) == set(names)
    assert set(checks.infer_all_column_types(df).values()) == {"numeric"}
    spikes = table(", ".join(f"{n} bigint" for n in names), [(i if i < 19 else 999,) * 8 for i in range(20)])
    assert list(checks.outlier_checks(spikes)) == names
    assert [m.high for m in stats.moments(spikes, names).values()] == [999] * 8


# ---- report ----


def messy(table):
    rows = [(i, "2024-01-0%d" % (i + 1), [" bob", "ALICE", "alice", "Bob", "", None][i], [5.0, -1.0, None, 2.0, 3.0, 4.0][i])
            for i in range(6)]
    return table("id bigint, day string, name string, amount double", rows)


def test_report_sections(table):
    found = report.build_report(messy(table))
    assert list(found) == ["dataset_level", "completeness", "column_types", "type_parsing",
                           "string_quality", "numeric_validity", "outliers"]
    assert found["column_types"] == {"id": "numeric", "day": "datetime", "name": "string", "amount": "numeric"}
    assert found["string_quality"]["name"] == {
        "leading_trailing_spaces": 1, "mixed_casing": True, "empty_strings": 1}
    assert found["numeric_validity"]["amount"] == {"negative_values": 1}
    json.dumps(found)


def given_report(**changes):
    base = {
        "dataset_level": {"row_count": 100, "column_count": 5, "duplicate_rows": 5, "fully_empty_rows": 2},
        "completeness": {c: {"missing_count": 0, "missing_pct": 0.0} for c in "abcde"},
        "column_types": dict.fromkeys("abcde", "string"),
        "type_parsing": {}, "string_quality": {}, "numeric_validity": {}, "outliers": {},
    }
    return {**base, **changes}


def health_of(found):
    return report.dataset_health(found, report.column_summary(found))


def test_summary_counts_a_flag_as_one(table):
    found = given_report(
        string_quality={"b": {"mixed_casing": True, "empty_strings": 4}},
        outliers={"c": {"outlier_count": 3, "outlier_pct": 3.0}},
        numeric_validity={"c": {"constant_column": True}},
    )
    rows = {r["column"]: r for r in report.column_summary(found)}
    assert rows["b"]["string_issues"] == 5 and rows["b"]["issue_score"] == 5
    assert rows["c"]["outlier_issues"] == 3 and rows["c"]["issue_score"] == 4
    assert [r["column"] for r in report.column_summary(found)] == ["b", "c", "a", "d", "e"]


def test_score_worked_by_hand():
    """180 penalties in 500 cells."""
    found = given_report(
        completeness={"a": {"missing_count": 50, "missing_pct": 50.0}, **{
            c: {"missing_count": 0, "missing_pct": 0.0} for c in "bcde"}},
        outliers={"b": {"outlier_count": 20, "outlier_pct": 20.0}},
        string_quality={"c": {"mixed_casing": True, "empty_strings": 3}},
    )
    assert health_of(found) == {"score": 64, "status": "Needs Attention ⚠️"}


@pytest.mark.parametrize("penalty, score, status", [
    (0, 100, "Healthy ✅"), (79, 85, "Healthy ✅"), (80, 84, "Needs Attention ⚠️"),
    (200, 60, "Needs Attention ⚠️"), (205, 59, "High Risk ❌"), (5000, 0, "High Risk ❌")])
def test_score_bands(penalty, score, status):
    level = {"row_count": 100, "column_count": 5, "duplicate_rows": 0, "fully_empty_rows": 0}
    found = given_report(dataset_level=level, type_parsing={"a": {"numeric_parse_failures": penalty}})
    assert health_of(found) == {"score": score, "status": status}


def test_score_of_an_empty_table():
    level = {"row_count": 0, "column_count": 0, "duplicate_rows": 0, "fully_empty_rows": 0}
    assert health_of(given_report(dataset_level=level))["score"] == 100


def test_summary_text():
    found = given_report(completeness={
        c: {"missing_count": n, "missing_pct": float(n)} for c, n in zip("abcde", [40, 10, 0, 31, 30])})
    summary = report.column_summary(found)
    assert report.executive_summary(found, {"score": 50, "status": "High Risk ❌"}, summary).splitlines() == [
        "Dataset Health: High Risk ❌ (Score: 50/100)", "Rows: 100, Columns: 5", "Duplicate rows: 5",
        "High missing data columns: a, d", "Highest risk columns: a, d, e"]


def test_tables_over_a_report(spark, table):
    quality = report.run_quality_checks(messy(table))
    by_rows = report.summarize_report(quality.report_frame(spark)).collect()
    by_dict = {r["column"]: r for r in quality.summary}
    assert {r["column"]: r["issue_score"] for r in by_rows} == {
        c: by_dict[c]["issue_score"] for c in (r["column"] for r in by_rows)}
    summary = quality.summary_frame(spark)
    assert [r["column"] for r in summary.collect()] == [r["column"] for r in quality.summary]
    assert report.high_missing_columns(summary, 10).count() == 2
    assert report.worst_columns(summary, 1).first()["column"] == quality.summary[0]["column"]


@pytest.mark.parametrize("name", ["region", "customer", "events", "documents", "embeddings", "pages", "labels",
                                  "conversations", "lineitem"])
def test_any_table_can_be_checked(spark, name):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    quality = report.run_quality_checks(df)
    assert quality.report["dataset_level"]["row_count"] == df.count()
    assert [r["column"] for r in quality.summary_frame(spark).collect()] and quality.text


def test_nested_columns_pass_through(spark):
    df = spark.range(8).selectExpr(
        "id % 2 as k", "if(id % 4 < 2, array(id % 2), null) as l", "map('a', id % 2) as m", "struct(id % 2 as x) as s")
    found = report.build_report(df)
    assert found["dataset_level"] == {"row_count": 8, "column_count": 4, "duplicate_rows": 4, "fully_empty_rows": 0}
    assert found["completeness"]["l"]["missing_count"] == 4
    assert ops.fill_nulls_batch(df, ["l", "k"], "mode").where("l is null").count() == 4
    with pytest.raises(ValueError, match="nested"):
        ops.fill_nulls(df, "l", "mode")


def test_ties_rank_in_column_order(spark):
    rows = [(c, 5, 1.0) for c in "abcyz"]
    summary = spark.createDataFrame(rows, "`column` string, issue_score int, missing_pct double")
    worst = report.worst_columns(summary, 3, columns=["z", "y", "c", "b", "a"])
    assert [r["column"] for r in worst.collect()] == ["z", "y", "c"]
