import pytest

from scrubline import operators as ops
from scrubline.operators import diff
from scrubline.plans import recipe


def test_mask(table):
    before = table("a double, b string", [(None, "x"), (2.0, "y"), (3.0, None), (float("nan"), "z")])
    after = table("a double, b string", [(1.0, "x"), (2.0, "Y"), (None, None), (None, "z")])
    rows = diff.diff_mask(before, after).orderBy("_row_id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(True, False), (False, True), (True, False), (False, False)]


def test_counts(table):
    before = table("a bigint, b string", [(1, "x"), (2, "y"), (3, None)])
    after = table("a bigint, b string", [(1, "X"), (20, "Y"), (3, None)])
    assert diff.count_changes(before, after) == {
        "total_cells_changed": 3, "rows_affected": 2, "columns_affected": ["a", "b"], "rows_added": 0,
        "rows_removed": 0, "columns_added": [], "columns_removed": [], "shape_changed": False}


def test_counts_of_other_shapes(table):
    before = table("a bigint, b string", [(1, "x"), (2, "y"), (3, None)])
    fewer = diff.count_changes(before, before.where("a > 1"))
    assert fewer["rows_removed"] == 1 and fewer["total_cells_changed"] is None and fewer["shape_changed"]
    assert diff.count_changes(before.where("a > 1"), before)["rows_added"] == 1
    narrower = diff.count_changes(before, before.drop("b"))
    assert narrower["columns_removed"] == ["b"] and narrower["shape_changed"]


def test_renamed_column_compares_the_rest(table):
    before = table("a bigint, b string", [(1, "x"), (2, "y")])
    changes = diff.count_changes(before, ops.rename_column(before, "b", "c"))
    assert changes["columns_added"] == ["c"] and changes["total_cells_changed"] == 0


def test_empty_tables_keep_their_shape(table):
    before = table("a bigint", [])
    assert diff.count_changes(before, before)["shape_changed"] is False


def test_changed_types_compare_by_value(table):
    before = table("a bigint, b string", [(1, "1"), (2, "x")])
    after = before.selectExpr("cast(a as double) as a", "try_cast(b as double) as b", "_row_id")
    assert diff.count_changes(before, after)["columns_affected"] == ["b"]


def test_affected_rows(table):
    before = table("a bigint", list(range(30)))
    after = ops.clip_numeric(before, "a", upper=9)
    old, new = diff.affected_rows(before, after, limit=5)
    assert [r["a"] for r in old.collect()] == [10, 11, 12, 13, 14]
    assert [r["a"] for r in new.collect()] == [9] * 5
    old, new = diff.affected_rows(before, before.where("a > 5"), limit=2)
    assert [r["a"] for r in old.collect()] == [0, 1] and [r["a"] for r in new.collect()] == [6, 7]


def test_column_changes(table):
    before = table("a double", [1.0, None, 3.0, None, 5.0, 6.0])
    after = table("a double", [1.0, 99.0, None, 99.0, 50.0, 6.0])
    found = diff.column_changes(before, after, "a")
    assert found["nulls_filled"] == 2 and found["nulls_created"] == 1 and found["values_changed"] == 1
    assert found["total_changes"] == 4
    assert found["sample_changes"][0] == {"index": 1, "before": "null", "after": 99.0}
    assert "error" in diff.column_changes(before, after, "z")
    assert "error" in diff.column_changes(before, after.where("_row_id > 0"), "a")


def test_summary_line():
    assert diff.format_diff_summary({"rows_removed": 2, "rows_affected": None}) == "🗑️ 2 rows removed"
    assert diff.format_diff_summary({}) == "No changes detected"
    line = diff.format_diff_summary({
        "rows_affected": 3, "total_cells_changed": 7, "columns_affected": ["a", "b", "c", "d", "e"]})
    assert line == "✏️ 3 rows modified | 📊 7 cells changed | 📋 Columns: a, b, c (+2 more)"


TYPES = {"a": "numeric", "s": "string"}
STEPS = [
    {"tool_name": "trim_spaces", "arguments": {"column": "s"}},
    {"tool_name": "fill_nulls", "arguments": {"column": "a", "method": "median"}},
    {"tool_name": "fill_nulls", "arguments": {"column": "a", "method": "ffill"}},
    {"tool_name": "remove_outliers", "arguments": {"column": "a", "action": "clip"}},
    {"tool_name": "convert_column_type", "arguments": {"column": "s", "target_type": "numeric"}},
    {"tool_name": "drop_rows_with_nulls", "arguments": {"column": "a"}},
    {"tool_name": "deduplicate_rows", "arguments": {"subset": ["s"]}},
    {"tool_name": "drop_column", "arguments": {"column": "s"}},
    {"tool_name": "rename_column", "arguments": {"column": "s", "new_name": "t"}},
    {"tool_name": "split_column", "arguments": {"column": "s", "delimiter": " ", "new_columns": ["x", "y"]}},
    {"tool_name": "drop_columns_batch", "arguments": {"columns": ["s"]}},
]


@pytest.mark.parametrize("step", STEPS, ids=lambda s: s["tool_name"])
def test_preview_agrees_with_a_full_comparison(table, step):
    """Carrying the old row along gives the counts of the join on row keys."""
    df = table("a double, s string", [(1.0, " x"), (None, "y"), (1000.0, " x"), (2.0, None), (3.0, "4"),
                                      (4.0, "a b"), (5.0, ""), (6.0, "y")])
    found = recipe.preview_step(df, step, TYPES)
    assert found["success"], found["error"]
    after = recipe.execute_tool(df, step, TYPES)
    assert found["changes"] == diff.count_changes(df, after)
    assert found["summary"] == diff.format_diff_summary(found["changes"])
    assert found["before_sample"].columns == df.columns
    assert found["after_sample"].columns == after.columns
    assert found["after_sample"].count() <= 5
    column = step["arguments"].get("column")
    if column and column in after.columns and not found["changes"]["rows_removed"]:
        assert found["column_changes"] == diff.column_changes(df, after, column)


def test_preview_reports_errors(table):
    df = table("a double, s string", [(1.0, "x")])
    found = recipe.preview_step(df, {"tool_name": "trim_spaces", "arguments": {"column": "a"}}, TYPES)
    assert not found["success"] and "string" in found["error"] and found["changes"] is None


@pytest.mark.parametrize("keys", [[1, 1, 2], [1, None, 2]])
def test_keys_that_repeat_or_miss_are_refused(spark, keys):
    df = spark.createDataFrame([(k, 1) for k in keys], "k bigint, x bigint")
    with pytest.raises(ValueError, match="key"):
        diff.count_changes(df, df, "k")


def test_wide_tables(spark):
    before = spark.range(10).selectExpr("id AS _row_id", *[f"id + {i} AS c{i}" for i in range(600)])
    after = before.withColumns({"c7": before["c7"] + 1, "c599": before["c599"] * 0})
    found = diff.count_changes(before, after)
    assert found["columns_affected"] == ["c7", "c599"] and found["total_cells_changed"] == 20


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_one_shuffle_and_no_join(spark):
    before = spark.range(100).selectExpr("id as k", "id % 7 as x")
    plan = diff.diff_mask(before, before.withColumn("x", before.x + 1), "k")
    assert exchanges(plan) == 1
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_faults_are_refused_wherever_they_lie(spark):
    good = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k bigint, x bigint")
    twice = spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "k bigint, x bigint")
    none = spark.createDataFrame([(1, 1), (None, 2), (None, 2)], "k bigint, x bigint")
    for bad, word in ((twice, "repeat"), (none, "without a key")):
        for before, after in ((good, bad), (bad, good), (bad, bad)):
            for compare in (
                lambda a, b: diff.count_changes(a, b, "k"), lambda a, b: diff.affected_rows(a, b, "k"),
                lambda a, b: diff.column_changes(a, b, "x", "k"), lambda a, b: diff.diff_mask(a, b, "k").collect(),
            ):
                with pytest.raises(Exception, match=word):
                    compare(before, after)


def test_a_key_repeated_by_most_rows_is_not_multiplied(spark):
    many = spark.range(20_000).selectExpr("id % 2 as k", "id as x")
    with pytest.raises(ValueError, match="repeat"):
        diff.count_changes(many, many, "k")


def test_many_columns_are_counted_by_number(spark, monkeypatch):
    before = spark.createDataFrame([(1, 1, "a"), (2, 2, None), (3, 3, "c")], "k bigint, x bigint, s string")
    after = spark.createDataFrame([(1, 1, "b"), (2, 5, "x"), (3, 3, None)], "k bigint, x bigint, s string")
    few = diff.count_changes(before, after, "k")
    monkeypatch.setattr(diff, "COLUMNS_COUNTED_APART", 0)
    assert diff.count_changes(before, after, "k") == few and few["total_cells_changed"] == 4
    with pytest.raises(ValueError, match="repeat"):
        diff.count_changes(before.union(before), after, "k")


def test_two_keys_nested_cells_and_keys_that_are_nan(spark):
    before = spark.createDataFrame([(1, "a", [1]), (1, "b", [2])], "k int, j string, n array<int>")
    after = spark.createDataFrame([(1, "b", [2]), (1, "a", [3]), (2, "a", None)], "k int, j string, n array<int>")
    rows = diff.diff_mask(before, after, ["k", "j"]).collect()
    assert {(r["k"], r["j"]): r["n"] for r in rows} == {(1, "a"): True, (1, "b"): False}
    nan = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "k double, x int")
    with pytest.raises(ValueError, match="without a key"):
        diff.count_changes(nan, nan, "k")
