import json

import pytest

from scrubline import operators as ops
from scrubline.operators import checks
from scrubline.plans import recipe, registry, report, suggest

TYPES = {"a": "numeric", "s": "string", "d": "string"}

# One valid call of every named step.
CALLS = {
    "fill_nulls": {"column": "a", "method": "mean"},
    "trim_spaces": {"column": "s"},
    "standardize_case": {"column": "s", "case": "upper"},
    "drop_rows_with_nulls": {"column": "a"},
    "round_numeric": {"column": "a", "decimals": 0, "method": "round"},
    "clip_numeric": {"column": "a", "lower": 0, "upper": 2},
    "remove_outliers": {"column": "a"},
    "scale_numeric": {"column": "a", "method": "zscore"},
    "apply_math": {"column": "a", "operation": "square"},
    "bin_numeric": {"column": "a", "bins": 3, "new_column": "b"},
    "replace_negative_values": {"column": "a", "replacement_value": "mean"},
    "replace_text": {"column": "s", "old_val": "x", "new_val": "y"},
    "replace_text_regex": {"column": "s", "pattern": r"\s+", "replacement": "_"},
    "create_calculated_column": {"new_column_name": "z", "formula": "a * 2"},
    "remove_special_chars": {"column": "s"},
    "pad_string": {"column": "s", "width": 5},
    "slice_string": {"column": "s", "start": 1},
    "add_prefix_suffix": {"column": "s", "prefix": "p"},
    "convert_to_datetime": {"column": "d"},
    "extract_date_part": {"column": "d", "part": "year", "new_column": "y"},
    "offset_date": {"column": "d", "value": 1, "unit": "months"},
    "date_difference": {"column": "d", "reference_date": "2024-06-01", "unit": "days"},
    "convert_column_type": {"column": "a", "target_type": "string"},
    "deduplicate_rows": {"subset": ["s"], "keep": "last"},
    "drop_column": {"column": "a"},
    "rename_column": {"column": "a", "new_name": "b"},
    "split_column": {"column": "d", "delimiter": "-", "new_columns": ["y", "m"]},
    "merge_columns": {"columns": ["s", "d"], "separator": "/", "new_column": "m"},
    "fill_nulls_batch": {"columns": ["all"], "method": "mode"},
    "trim_spaces_batch": {"columns": ["all"]},
    "standardize_case_batch": {"columns": ["s", "d"], "case": "title"},
    "drop_columns_batch": {"columns": ["a", "nope"]},
}


def step(name, **arguments):
    return {"tool_name": name, "arguments": arguments or CALLS[name]}


@pytest.fixture
def data(table):
    rows = [(1.0, " x y", "2024-01-31"), (None, "x", "2024-02-01"), (-3.0, None, "bad"), (2.0, "x", None)]
    return table("a double, s string, d string", rows)


def test_all_steps_are_named():
    assert set(registry.REGISTRY) == set(CALLS) and len(CALLS) == 32


def sorted_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", CALLS)
def test_every_step_runs_described_fitted_and_replayed(data, name):
    call = step(name)
    done = recipe.execute_tool(data, call, TYPES)
    want = sorted_rows(done)
    said = registry.describe_tool_call(call)
    assert said != "Unknown action" and "?" not in said.replace("\\s+", "")
    fitted = recipe.fit_steps(data, [call], TYPES)
    assert sorted_rows(recipe.execute_tool(data, fitted[0], TYPES)) == want
    space = {}
    exec(recipe.replay_script([call]), space)
    assert sorted_rows(space["clean_dataset"](data)) == want
    assert call["arguments"] == CALLS[name], "a step must not change its arguments"


def test_schemas_are_complete():
    schemas = {s["function"]["name"]: s["function"]["parameters"] for s in registry.tool_schemas()}
    assert set(schemas) == set(CALLS)
    for name, arguments in CALLS.items():
        assert set(schemas[name]["required"]) <= set(arguments) <= set(schemas[name]["properties"])
    json.dumps(schemas)
    assert schemas["standardize_case"]["properties"]["case"]["enum"] == ["lower", "upper", "title"]
    assert schemas["merge_columns"]["properties"]["columns"] == {"type": "array", "items": {"type": "string"}}


@pytest.mark.parametrize(
    "call, message",
    [
        (step("trim_spaces", column="nope"), "not found"),
        (step("trim_spaces", column="a"), "string"),
        (step("round_numeric", column="s", decimals=1, method="round"), "numeric"),
        (step("fill_nulls", column="s", method="mean"), "numeric"),
        (step("fill_nulls", column="a", method="guess"), "method"),
        (step("fill_nulls", column="a"), "required"),
        (step("round_numeric", column="a", decimals="two", method="round"), "wrong type"),
        (step("trim_spaces", column="s", extra=1), "unknown"),
        (step("sort_rows", column="s"), "Unsupported tool"),
    ],
)
def test_refusals(data, call, message):
    with pytest.raises(ValueError, match=message):
        recipe.execute_tool(data, call, TYPES)


def test_descriptions():
    say = registry.describe_tool_call
    assert say(step("fill_nulls")) == "Put the column's mean where 'a' has no value."
    assert "last value" in say(step("fill_nulls", column="a", method="ffill"))
    assert say(step("fill_nulls", column="a", method="custom", value=0)).startswith("Put 0 where")
    assert say(step("clip_numeric", column="a", lower=1)) == "Hold 'a' within 1 and inf."
    assert say(step("remove_outliers", column="a", action="mean")).startswith("Put the column's mean")
    assert say(step("deduplicate_rows", keep="last")) == "Of equal rows keep the last."
    assert "agree in x, y" in say(step("deduplicate_rows", subset=["x", "y"]))
    batch = say(step("fill_nulls_batch", columns=list("abcde"), method="mode"))
    assert batch == "Put each column's mode where a, b, c (+2 more) have no value."
    assert say(step("date_difference", column="d")).endswith("from 'd' to today.")
    assert say({"tool_name": "nothing", "arguments": {}}) == "Unknown action"


def test_text_typed_numeric_is_refused_by_the_operator(table):
    df = table("t string", ["1", "2", "3", "4", "x"])
    types = checks.infer_all_column_types(df)
    assert types == {"t": "numeric"}
    with pytest.raises(ValueError, match="convert to numeric first"):
        recipe.execute_tool(df, step("fill_nulls", column="t", method="mean"), types)


def test_stop_or_skip(data, values):
    steps = [step("trim_spaces"), step("trim_spaces", column="a"), step("standardize_case")]
    df, applied, errors = recipe.apply_steps(data, steps, TYPES)
    assert len(applied) == 1 and len(errors) == 1 and values(df, "s")[0] == "x y"
    df, applied, errors = recipe.apply_steps(data, steps, TYPES, on_error="skip")
    assert len(applied) == 2 and len(errors) == 1 and values(df, "s")[0] == "X Y"
    with pytest.raises(ValueError):
        recipe.apply_steps(data, steps, TYPES, on_error="ask")


def test_long_chains_can_be_cut(data, values):
    steps = [step("add_prefix_suffix", column="s", prefix="p")] * 6
    df, _, errors = recipe.apply_steps(data, steps, TYPES, checkpoint_every=2)
    assert not errors and values(df, "s")[1] == "ppppppx"
    shuffling = [step("deduplicate_rows", subset=["s"]), step("fill_nulls", column="a", method="ffill")]
    df, _, errors = recipe.apply_steps(data, shuffling, TYPES, checkpoint_shuffles=True)
    assert not errors and values(df, "a") == [1.0, 1.0, -3.0]


def test_log_undo_and_replay(spark, data, values):
    log = recipe.CleaningLog(data, TYPES).apply(step("trim_spaces"))
    log.apply(step("standardize_case"), step("fill_nulls"))
    assert log.descriptions() == ["Cut white space off both ends of 's'.", "Write 's' in upper case.",
                                  "Put the column's mean where 'a' has no value."]
    again, _, _ = recipe.apply_steps(data, recipe.steps_from_json(log.to_json()), TYPES)
    assert values(again, "s") == values(log.df, "s") == ["X Y", "X", None, "X"]
    rows = log.frame(spark).collect()
    assert [r["seq"] for r in rows] == [1, 2, 3] and json.loads(rows[0]["arguments"]) == {"column": "s"}
    log.undo()
    assert len(log.steps) == 1 and values(log.df, "s")[0] == "x y"
    log.undo().undo()
    assert log.steps == [] and values(log.df, "s")[0] == " x y"


def test_failed_batches_leave_no_trace(data):
    log = recipe.CleaningLog(data, TYPES).apply(step("trim_spaces", column="a"))
    assert log.steps == [] and log.errors and log.df is data


def test_override(data, values):
    df, types = recipe.override_type(data, TYPES, "d", "datetime")
    assert types["d"] == "datetime" and values(df, "d")[2] is None
    assert recipe.override_type(data, TYPES, "a", "numeric")[0] is data


def test_new_steps_can_be_registered(data, values):
    registry.register(registry.Tool("shout", lambda df, column: ops.standardize_case(df, column, "upper"), "Shout",
                                    {"column": registry.Arg()}, lambda a: f"Shout {a['column']}.", "string"))
    try:
        assert values(recipe.execute_tool(data, step("shout", column="s"), TYPES), "s")[1] == "X"
        with pytest.raises(ValueError):
            registry.register(registry.REGISTRY["shout"])
    finally:
        del registry.REGISTRY["shout"]


# ---- suggestions ----


def findings(**sections):
    base = {"dataset_level": {"row_count": 10, "duplicate_rows": 0}, "completeness": {}, "string_quality": {},
            "outliers": {}, "numeric_validity": {}, "type_parsing": {}, "column_types": TYPES}
    return {**base, **sections}


def calls(found):
    return [(s["tool_name"], s["arguments"], s["priority"]) for s in suggest.generate_suggestions(found)]


def test_nothing_to_suggest():
    assert calls(findings()) == []


@pytest.mark.parametrize("kind, method", [("numeric", "median"), ("datetime", "ffill"), ("string", "mode"),
                                          ("boolean", "mode")])
@pytest.mark.parametrize("percent, priority", [(20.1, "high"), (20, "medium"), (5.5, "medium"), (5, "low")])
def test_fills(kind, method, percent, priority):
    found = findings(completeness={"x": {"missing_count": 2, "missing_pct": percent}}, column_types={"x": kind})
    assert calls(found) == [("fill_nulls", {"column": "x", "method": method}, priority)]


def test_other_rules():
    found = findings(
        dataset_level={"row_count": 10, "duplicate_rows": 3},
        string_quality={"s": {"leading_trailing_spaces": 4, "mixed_casing": True}},
        outliers={"a": {"outlier_count": 2, "outlier_pct": 11.0}},
        numeric_validity={"a": {"negative_values": 1, "constant_column": True}},
        type_parsing={"n": {"numeric_parse_failures": 2}, "d": {"datetime_parse_failures": 5}},
    )
    assert calls(found) == [
        ("deduplicate_rows", {"keep": "first"}, "high"),
        ("remove_outliers", {"column": "a", "method": "iqr", "action": "clip"}, "high"),
        ("convert_to_datetime", {"column": "d"}, "medium"),
        ("trim_spaces", {"column": "s"}, "medium"),
        ("convert_column_type", {"column": "n", "target_type": "numeric"}, "medium"),
        ("replace_negative_values", {"column": "a", "replacement_value": 0}, "medium"),
        ("standardize_case", {"column": "s", "case": "title"}, "low"),
    ]


@pytest.mark.parametrize("issues", [{"empty_strings": 5}, {"leading_trailing_spaces": 2, "empty_strings": 5}])
def test_blanks_are_emptied_before_they_are_filled(table, values, issues):
    steps = suggest.generate_suggestions(findings(string_quality={"s": issues}))
    names = [s["tool_name"] for s in steps]
    assert names.index("trim_spaces") < names.index("fill_nulls")
    df, _, errors = recipe.apply_steps(table("s string", ["", "a", " ", "a"]), steps, {"s": "string"})
    assert not errors and values(df, "s") == ["a"] * 4


def test_ranking_and_views(spark):
    found = [suggest._step("t", {}, str(i), n, p, c) for i, (n, p, c) in enumerate(
        [(1, "low", "x"), (9, "high", "y"), (5, "odd", "x"), (9, "high", "x"), (20, "medium", "z")])]
    ranked = suggest.rank_suggestions(found)
    assert [s["description"] for s in ranked] == ["1", "3", "4", "2", "0"]
    frame = suggest.suggestions_frame(spark, found)
    assert [r["description"] for r in suggest.rank_frame(frame).collect()] == ["1", "3", "4", "2", "0"]
    assert [r["description"] for r in suggest.top_frame(frame, 2).collect()] == ["1", "3"]
    assert len(suggest.top_suggestions(ranked, 2)) == 2
    assert suggest.suggestion_summary(found) == {"x": 3, "y": 1, "z": 1}
    assert {r["category"]: r["count"] for r in suggest.category_counts(frame).collect()} == {"x": 3, "y": 1, "z": 1}
    assert len(suggest.suggestions_by_category(found, "x")) == suggest.category_frame(frame, "x").count() == 3


def test_applying_all_suggestions_raises_the_score(table):
    rows = [(i, f" n{i % 7}", float(i) if i % 4 else None, "x" if i % 5 else "") for i in range(60)]
    df = table("id bigint, name string, amount double, kind string", rows + rows[:5])
    before = report.run_quality_checks(df)
    steps = [{k: s[k] for k in ("tool_name", "arguments")} for s in suggest.generate_suggestions(before.report)]
    cleaned, _, errors = recipe.apply_steps(df, steps, before.report["column_types"], on_error="skip")
    after = report.run_quality_checks(cleaned)
    assert not errors and after.health["score"] == 100 > before.health["score"]
    assert cleaned.count() == 60
