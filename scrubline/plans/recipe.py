"""Applying named steps: one, a chain, a dry run, with a log and undo."""

from __future__ import annotations

import inspect
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scrubline.frames import ROW_ID, data_columns, named
from scrubline.operators import diff
from scrubline.operators.checks import infer_all_column_types
from scrubline.operators.types import convert_column_type
from scrubline.plans.registry import describe_tool_call, lookup
from scrubline.session import cut_lineage

STEP_SCHEMA = "seq int, tool_name string, arguments string, description string"


def _expanded(df: DataFrame, tool, arguments: Mapping) -> dict:
    """The arguments with 'all' spelled out; the caller's step is not touched."""
    arguments = {k: v for k, v in arguments.items()}
    if tool.all_columns and "all" in (arguments.get("columns") or []):
        arguments["columns"] = tool.all_columns(df)
    return arguments


def _prepared(df: DataFrame, step: Mapping, column_types: Mapping[str, str] | None):
    """Check a step against the table before any work is planned."""
    tool = lookup(step["tool_name"])
    arguments = _expanded(df, tool, step["arguments"])
    column = arguments.get("column")
    if column is not None and column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    tool.check(arguments)
    if tool.gate and column_types is not None and tool.gate_when(arguments):
        if column_types.get(column) != tool.gate:
            raise ValueError(f"{tool.name} is only for {tool.gate} columns")
    return tool, {k: v for k, v in arguments.items() if v is not None}


def _call(tool, df: DataFrame, arguments: dict, fitted: dict | None) -> DataFrame:
    if "order_by" in arguments and "order_by" not in inspect.signature(tool.run).parameters:
        arguments = {k: v for k, v in arguments.items() if k != "order_by"}
    if fitted is not None:
        arguments["stats"] = fitted
    return tool.run(df, **arguments)


def execute_tool(
    df: DataFrame, step: Mapping, column_types: Mapping[str, str] | None = None
) -> DataFrame:
    """Apply one named step; the type gate holds when logical types are given."""
    tool, arguments = _prepared(df, step, column_types)
    return _call(tool, df, arguments, step.get("stats"))


def apply_steps(
    df: DataFrame,
    steps: Sequence[Mapping],
    column_types: Mapping[str, str] | None = None,
    on_error: str = "stop",
    checkpoint_every: int | None = None,
    checkpoint_shuffles: bool = False,
) -> tuple[DataFrame, list[dict], list[str]]:
    """Apply steps in turn; returns the table, the steps applied and the errors.

    ``on_error`` either stops at the first failing step or skips it. A step that
    needs statistics computes them from the source through all earlier steps; to
    not repeat costly ones, the table can be written to the shared folder every
    few steps, or after each step that shuffles whole rows.
    """
    if on_error not in ("stop", "skip"):
        raise ValueError(f"unknown on_error {on_error!r}")
    applied: list[dict] = []
    errors: list[str] = []
    for step in steps:
        try:
            df = execute_tool(df, step, column_types)
        except Exception as error:
            errors.append(f"{step.get('tool_name')}: {error}")
            if on_error == "stop":
                break
            continue
        applied.append(dict(step))
        due = checkpoint_every and len(applied) % checkpoint_every == 0
        if due or (checkpoint_shuffles and _shuffles(step)):
            df = cut_lineage(df)
    return df, applied, errors


def _shuffles(step: Mapping) -> bool:
    along = step["arguments"].get("method") in ("ffill", "bfill")
    return step["tool_name"] == "deduplicate_rows" or along


def fit_steps(
    df: DataFrame, steps: Sequence[Mapping], column_types: Mapping[str, str] | None = None
) -> list[dict]:
    """The same steps with the statistics they need fitted on this table, so
    that they replay on other rows, or on a stream, without a second look."""
    fitted = []
    for step in steps:
        tool, arguments = _prepared(df, step, column_types)
        found = tool.fit(df, arguments) if tool.fit else None
        step = {**step, "arguments": {k: v for k, v in arguments.items()}}
        if found is not None:
            step["stats"] = found
        df = _call(tool, df, dict(arguments), found)
        fitted.append(step)
    return fitted


def override_type(
    df: DataFrame, column_types: Mapping[str, str], column: str, target_type: str, **more
) -> tuple[DataFrame, dict[str, str]]:
    """Set a column's logical type and convert the column to it."""
    if column_types.get(column) == target_type:
        return df, dict(column_types)
    return (
        convert_column_type(df, column, target_type, **more),
        {**column_types, column: target_type},
    )


# ---- dry run ----


def preview_step(
    df: DataFrame,
    step: Mapping,
    column_types: Mapping[str, str] | None = None,
    key: str | Sequence[str] = ROW_ID,
) -> dict:
    """What a step would do: changes, samples and text, or the error."""
    outcome = dict.fromkeys(
        ["changes", "summary", "before_sample", "after_sample", "column_changes", "error"]
    )
    try:
        keys = [key] if isinstance(key, str) else list(key)
        if step.get("stats") is None:
            # look at the table once, not again for every part of the outcome
            step = fit_steps(df, [step], column_types)[0]
        pairs = _carried(df, step, column_types, keys)
        after = execute_tool(df, step, column_types)
        if pairs is None:
            pairs = diff.paired(df, after, key)
        changes = diff.count_pairs(pairs)
        if changes["shape_changed"]:
            order = [named(k) for k in keys]
            before_sample = df.orderBy(*order).limit(diff.SAMPLE)
            after_sample = after.orderBy(*order).limit(diff.SAMPLE)
        else:
            picked = diff.affected_pairs(pairs, keys, diff.SAMPLE)
            before_sample = diff.unpacked(picked, keys, diff.BEFORE, df.columns)
            after_sample = diff.unpacked(picked, keys, diff.AFTER, after.columns)
        column = step.get("arguments", {}).get("column")
        if column in df.columns and column not in keys:
            if column not in after.columns:
                outcome["column_changes"] = {"error": "Column not found in one of the DataFrames"}
            elif changes["rows_added"] or changes["rows_removed"]:
                outcome["column_changes"] = {"error": "Row counts differ"}
            else:
                outcome["column_changes"] = diff.column_changes_of(pairs, keys, column)
        return {
            **outcome,
            "success": True,
            "changes": changes,
            "summary": diff.format_diff_summary(changes),
            "before_sample": before_sample,
            "after_sample": after_sample,
        }
    except Exception as error:
        return {**outcome, "success": False, "error": str(error)}


# Steps that keep every row where it is, so both versions can travel together.
_ROW_WISE = {
    "trim_spaces", "standardize_case", "round_numeric", "clip_numeric", "scale_numeric",
    "apply_math", "bin_numeric", "replace_negative_values", "replace_text", "replace_text_regex",
    "create_calculated_column", "remove_special_chars", "pad_string", "slice_string",
    "add_prefix_suffix", "convert_to_datetime", "extract_date_part", "offset_date",
    "date_difference", "convert_column_type", "drop_column", "split_column", "merge_columns",
    "trim_spaces_batch", "standardize_case_batch", "drop_columns_batch",
}


def _carried(df, step, column_types, keys) -> DataFrame | None:
    """Both versions of every row without a join: the old row rides along as one
    more column while the step is applied. Only for steps that keep all rows."""
    action = (step.get("arguments") or {}).get("action", "null")
    method = (step.get("arguments") or {}).get("method")
    row_wise = step["tool_name"] in _ROW_WISE
    row_wise |= step["tool_name"] == "remove_outliers" and action != "drop"
    row_wise |= step["tool_name"] in ("fill_nulls", "fill_nulls_batch") and method not in ("ffill", "bfill")
    if not row_wise:
        return None
    tool, arguments = _prepared(df, step, column_types)
    after = _call(tool, df.withColumn(diff.BEFORE, diff.packed(df, keys)), arguments, step.get("stats"))
    if any(k not in after.columns for k in keys):
        return None
    return after.select(
        *[named(k) for k in keys],
        named(diff.BEFORE),
        diff.packed(after, [*keys, diff.BEFORE]).alias(diff.AFTER),
    )


# ---- log, undo and replay ----


@dataclass
class _State:
    df: DataFrame
    applied: int


class CleaningLog:
    """A table under cleaning: its steps in order, undo, and scripts to replay.

    Earlier versions are kept as plans, not as data.
    """

    def __init__(self, df: DataFrame, column_types: Mapping[str, str] | None = None):
        self.df = df
        self.column_types = dict(column_types) if column_types is not None else None
        self.steps: list[dict] = []
        self.errors: list[str] = []
        self._states: list[_State] = []

    def apply(self, *steps: Mapping, on_error: str = "stop") -> CleaningLog:
        """Apply a batch of steps; one undo takes the whole batch back."""
        state = _State(self.df, len(self.steps))
        self.df, applied, self.errors = apply_steps(self.df, steps, self.column_types, on_error)
        if applied:
            self._states.append(state)
            self.steps += applied
        return self

    def refresh_types(self) -> dict[str, str]:
        """Infer the logical types again after the columns have changed."""
        self.column_types = infer_all_column_types(self.df)
        return self.column_types

    def undo(self) -> CleaningLog:
        if self._states:
            state = self._states.pop()
            self.df = state.df
            del self.steps[state.applied :]
        return self

    def descriptions(self) -> list[str]:
        return [describe_tool_call(s) for s in self.steps]

    def frame(self, spark: SparkSession) -> DataFrame:
        return steps_frame(spark, self.steps)

    def to_json(self) -> str:
        return steps_to_json(self.steps)

    def script(self) -> str:
        return replay_script(self.steps)


def steps_frame(spark: SparkSession, steps: Sequence[Mapping]) -> DataFrame:
    """The ordered log as a table."""
    rows = [
        (i, s["tool_name"], json.dumps(s["arguments"], ensure_ascii=False), describe_tool_call(s))
        for i, s in enumerate(steps, 1)
    ]
    return spark.createDataFrame(rows, STEP_SCHEMA)


def steps_to_json(steps: Sequence[Mapping]) -> str:
    return json.dumps(list(steps), indent=2, ensure_ascii=False)


def steps_from_json(text: str) -> list[dict]:
    steps = json.loads(text)
    for step in steps:
        tool = lookup(step["tool_name"])
        tool.check(step["arguments"])
    return steps


def replay_script(steps: Sequence[Mapping]) -> str:
    """A Python script that applies the same steps to any table."""
    lines = ["from scrubline import operators as ops", "", "", "def clean_dataset(df):"]
    for step in steps:
        given = {k: repr(v) for k, v in step["arguments"].items() if v is not None}
        if "all" in (step["arguments"].get("columns") or []):
            given["columns"] = "ops.text_columns(df)"
            if lookup(step["tool_name"]).all_columns is data_columns:
                given["columns"] = "ops.data_columns(df)"
        arguments = "".join(f", {k}={v}" for k, v in given.items())
        if step.get("stats") is not None:
            arguments += f", stats={step['stats']!r}"
        lines.append(f"    df = ops.{step['tool_name']}(df{arguments})")
    return "\n".join([*lines, "    return df", ""])
