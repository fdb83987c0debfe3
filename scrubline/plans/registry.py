"""The named cleaning steps: arguments, type gate, sentence, and function.

A step is ``{"tool_name": ..., "arguments": {...}}``, optionally with the
``"stats"`` it was fitted with. New steps are added with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from scrubline.frames import data_columns, is_nested, is_numeric, text_columns
from scrubline.operators import columns, dates, diff, missing, numbers, rows, strings, types


@dataclass(frozen=True)
class Arg:
    """One argument: its JSON type or types, and whether it must be given."""

    kind: str | tuple[str, ...] = "string"
    required: bool = True
    choices: tuple = ()
    about: str = ""

    def schema(self) -> dict:
        kinds = self.kind if isinstance(self.kind, str) else list(self.kind)
        found: dict = {"type": kinds}
        if kinds == "array":
            found["items"] = {"type": "string"}
        if self.choices:
            found["enum"] = list(self.choices)
        if self.about:
            found["description"] = self.about
        return found

    def accepts(self, given: object) -> bool:
        kinds = (self.kind,) if isinstance(self.kind, str) else self.kind
        return any(_IS[k](given) for k in kinds)


_IS: dict[str, Callable[[object], bool]] = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v),
    "null": lambda v: v is None,
}


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    about: str
    args: Mapping[str, Arg]
    describe: Callable[[dict], str]
    gate: str | None = None
    gate_when: Callable[[dict], bool] = field(default=lambda args: True)
    # fits the statistics a step needs; None when it needs none for these arguments
    fit: Callable[[DataFrame, dict], dict | None] | None = None
    # columns meant by the word 'all' in a list of columns
    all_columns: Callable[[DataFrame], list[str]] | None = None

    def schema(self) -> dict:
        """The step as a function description in JSON Schema."""
        return {
            "type": "function",
            "function": {
                "name": self.name,
                "description": self.about,
                "parameters": {
                    "type": "object",
                    "properties": {n: a.schema() for n, a in self.args.items()},
                    "required": [n for n, a in self.args.items() if a.required],
                },
            },
        }

    def check(self, arguments: Mapping) -> None:
        for name, arg in self.args.items():
            if name not in arguments:
                if arg.required:
                    raise ValueError(f"{self.name}: argument '{name}' is required")
                continue
            given = arguments[name]
            if given is None and not arg.required:
                continue
            if arg.choices and given not in arg.choices:
                raise ValueError(f"{self.name}: unsupported {name} {given!r}")
            if not arg.choices and not arg.accepts(given):
                raise ValueError(f"{self.name}: wrong type for '{name}': {type(given).__name__}")
        unknown = set(arguments) - set(self.args) - {"order_by"}
        if unknown:
            raise ValueError(f"{self.name}: unknown argument {sorted(unknown)[0]!r}")


REGISTRY: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    if tool.name in REGISTRY:
        raise ValueError(f"step '{tool.name}' is already registered")
    REGISTRY[tool.name] = tool
    return tool


def tool_schemas() -> list[dict]:
    return [t.schema() for t in REGISTRY.values()]


def lookup(name: str) -> Tool:
    if name not in REGISTRY:
        raise ValueError(f"Unsupported tool: {name}")
    return REGISTRY[name]


def describe_tool_call(step: Mapping) -> str:
    """One sentence about a step, for previews and logs."""
    if step["tool_name"] not in REGISTRY:
        return "Unknown action"
    return REGISTRY[step["tool_name"]].describe(dict(step["arguments"]))


# ---- sentences ----


class _Blank(dict):
    def __missing__(self, key):
        return "?"


def _says(template: str, **defaults) -> Callable[[dict], str]:
    """Fill a template with the arguments, defaults for those left out."""

    def sentence(args: dict) -> str:
        shown = {k: diff.listed(v, len(v)) if isinstance(v, (list, tuple)) else v for k, v in args.items()}
        given = {k: v for k, v in shown.items() if v is not None}
        return template.format_map(_Blank({**defaults, **given}))

    return sentence


_FILL = "Put the column's {method} where '{column}' has no value."
_FILL_CASES = {
    "custom": "Put {value} where '{column}' has no value.",
    "zero": "Put 0 where '{column}' has no value.",
    "ffill": "Carry the last value of '{column}' on to rows without one.",
    "bfill": "Carry the next value of '{column}' back to rows without one.",
}
_FILL_BATCH = "Put each column's {method} where {columns} have no value."
_FILL_BATCH_CASES = {
    "custom": "Put {value} where {columns} have no value.",
    "zero": "Put 0 where {columns} have no value.",
    "ffill": "Carry the last values of {columns} on to rows without one.",
    "bfill": "Carry the next values of {columns} back to rows without one.",
}
_OUTLIERS = {
    "null": "Empty the {method} outliers of '{column}'.",
    "drop": "Leave out rows whose '{column}' is an outlier by {method}.",
    "clip": "Pull the {method} outliers of '{column}' back to the fences.",
    "replace": "Put {value} in place of the {method} outliers of '{column}'.",
    "mean": "Put the column's mean in place of the {method} outliers of '{column}'.",
    "median": "Put the column's median in place of the {method} outliers of '{column}'.",
}
_NEGATIVES = "Put {replacement_value} where '{column}' is below zero."
_NEGATIVES_STATISTIC = "Put the column's {replacement_value} where '{column}' is below zero."
_COPIES = "Of equal rows keep the {keep}."
_COPIES_SUBSET = "Of rows that agree in {subset} keep the {keep}."


def _say_fill(args: dict) -> str:
    return _says(_FILL_CASES.get(args.get("method"), _FILL))(args)


def _first_columns(args: dict) -> dict:
    return {**args, "columns": diff.listed(args.get("columns") or [])}


def _say_fill_batch(args: dict) -> str:
    return _says(_FILL_BATCH_CASES.get(args.get("method"), _FILL_BATCH))(_first_columns(args))


def _say_outliers(args: dict) -> str:
    return _says(_OUTLIERS[args.get("action") or "null"], method="iqr")(args)


def _say_negatives(args: dict) -> str:
    fill = args.get("replacement_value", 0.0)
    statistic = isinstance(fill, str) and fill.lower() in ("mean", "median")
    return _says(_NEGATIVES_STATISTIC if statistic else _NEGATIVES, replacement_value=0.0)(args)


def _say_dedup(args: dict) -> str:
    return _says(_COPIES_SUBSET if args.get("subset") else _COPIES, keep="first")(args)


# ---- fitting ----


def _fit_fill(df: DataFrame, a: dict) -> dict | None:
    if a["method"] not in ("mean", "median", "mode"):
        return None
    return missing.fit_fill(df, [a["column"]], a["method"])


def _fit_fill_batch(df: DataFrame, a: dict) -> dict | None:
    wanted = [c for c in a["columns"] if c in df.columns and not is_nested(df, c)]
    if a["method"] in ("mean", "median"):
        wanted = [c for c in wanted if is_numeric(df, c)]
    elif a["method"] != "mode":
        return None
    return missing.fit_fill(df, wanted, a["method"])


def _fit_outliers(df: DataFrame, a: dict) -> dict:
    action = numbers._named_action(a.get("action") or "null", a.get("value"))
    return numbers.fit_outliers(df, a["column"], a.get("method") or "iqr", action)


def _fit_negatives(df: DataFrame, a: dict) -> dict | None:
    fill = a.get("replacement_value", 0.0)
    if isinstance(fill, str) and fill.lower() in ("mean", "median"):
        return numbers.fit_negatives(df, a["column"], fill)
    return None


def _fit_dates(df: DataFrame, a: dict) -> dict | None:
    if a.get("format"):
        return None
    return dates.fit_format(df, a["column"], a.get("order_by"))


def _fit_type(df: DataFrame, a: dict) -> dict | None:
    if a["target_type"] == "datetime":
        return _fit_dates(df, a)
    if a["target_type"] == "categorical":
        return types.fit_categories(df, a["column"])
    return None


# ---- the steps ----

_COLUMN = Arg()
_COLUMNS = Arg("array")
_NEW = Arg(required=False, about="name of the result column; the source is overwritten without it")
_ANY = Arg(("string", "number", "boolean", "null"), required=False)


def _choice(*values, required: bool = True) -> Arg:
    return Arg(choices=tuple(values), required=required)


def _optional(kind: str, about: str = "") -> Arg:
    return Arg(kind, required=False, about=about)


def _add(name, run, about, args, describe, **more) -> None:
    register(Tool(name, run, about, args, describe, **more))


_add("fill_nulls", missing.fill_nulls, "Fill missing values of a column",
     {"column": _COLUMN, "method": _choice(*missing.FILL_METHODS), "value": _ANY}, _say_fill,
     gate="numeric", gate_when=lambda a: a["method"] in ("mean", "median"), fit=_fit_fill)
_add("trim_spaces", strings.trim_spaces, "Strip white space from both ends of a string column",
     {"column": _COLUMN}, _says("Cut white space off both ends of '{column}'."), gate="string")
_add("standardize_case", strings.standardize_case, "Bring a string column to one letter case",
     {"column": _COLUMN, "case": _choice(*strings.CASES)},
     _says("Write '{column}' in {case} case."), gate="string")
_add("drop_rows_with_nulls", missing.drop_rows_with_nulls, "Drop the rows where a column is missing",
     {"column": _COLUMN}, _says("Keep only rows with a value in '{column}'."))
_add("round_numeric", numbers.round_numeric, "Round a numeric column",
     {"column": _COLUMN, "decimals": Arg("integer"), "method": _choice(*numbers.ROUNDINGS)},
     _says("Shorten '{column}' to {decimals} decimal places by {method}."), gate="numeric")
_add("clip_numeric", numbers.clip_numeric, "Bound a numeric column",
     {"column": _COLUMN, "lower": _optional("number"), "upper": _optional("number")},
     _says("Hold '{column}' within {lower} and {upper}.", lower="-inf", upper="inf"), gate="numeric")
_add("remove_outliers", numbers.remove_outliers, "Find outliers of a numeric column and treat them",
     {"column": _COLUMN, "method": _choice(*numbers.OUTLIER_METHODS, required=False),
      "action": _choice(*numbers.OUTLIER_ACTIONS, required=False), "value": _ANY},
     _say_outliers, gate="numeric", fit=_fit_outliers)
_add("scale_numeric", numbers.scale_numeric, "Scale a numeric column by range or by deviation",
     {"column": _COLUMN, "method": _choice(*numbers.SCALINGS)},
     _says("Rescale '{column}' by {method}."), gate="numeric",
     fit=lambda df, a: numbers.fit_scale(df, a["column"], a["method"]))
_add("apply_math", numbers.apply_math, "Apply a function to a numeric column",
     {"column": _COLUMN, "operation": _choice(*numbers.MATH)},
     _says("Take the {operation} of '{column}'."), gate="numeric")
_add("bin_numeric", numbers.bin_numeric, "Sort a numeric column into intervals of equal width",
     {"column": _COLUMN, "bins": Arg("integer"), "labels": _optional("array"), "new_column": _NEW},
     _says("Sort '{column}' into {bins} intervals."), gate="numeric",
     fit=lambda df, a: numbers.fit_bins(df, a["column"], a["bins"]))
_add("replace_negative_values", numbers.replace_negative_values, "Replace negative numbers",
     {"column": _COLUMN, "replacement_value": Arg(("number", "string"), required=False)},
     _say_negatives, gate="numeric", fit=_fit_negatives)
_add("replace_text", strings.replace_text, "Replace a piece of text",
     {"column": _COLUMN, "old_val": Arg(), "new_val": Arg()},
     _says("Write '{new_val}' for every '{old_val}' in '{column}'."), gate="string")
_add("replace_text_regex", strings.replace_text_regex, "Replace the matches of a regular expression",
     {"column": _COLUMN, "pattern": Arg(), "replacement": Arg()},
     _says("Write '{replacement}' for every match of '{pattern}' in '{column}'."), gate="string")
_add("create_calculated_column", columns.create_calculated_column,
     "Add a column computed from others by a formula",
     {"new_column_name": Arg(), "formula": Arg()},
     _says("Compute '{new_column_name}' from {formula}."))
_add("remove_special_chars", strings.remove_special_chars,
     "Keep only letters, digits and white space", {"column": _COLUMN},
     _says("Keep only letters, digits and spaces in '{column}'."), gate="string")
_add("pad_string", strings.pad_string, "Pad a string column to a width",
     {"column": _COLUMN, "width": Arg("integer"), "fillchar": _optional("string"),
      "side": _choice(*strings.PAD_SIDES, required=False)},
     _says("Lengthen '{column}' to {width} characters with '{fillchar}' on the {side}.",
           fillchar="0", side="left"), gate="string")
_add("slice_string", strings.slice_string, "Cut out a range of characters",
     {"column": _COLUMN, "start": _optional("integer"), "end": _optional("integer")},
     _says("Keep characters {start} to {end} of '{column}'.", start=0, end="end"), gate="string")
_add("add_prefix_suffix", strings.add_prefix_suffix, "Put text before and after a string column",
     {"column": _COLUMN, "prefix": _optional("string"), "suffix": _optional("string")},
     _says("Put '{prefix}' before and '{suffix}' after '{column}'.", prefix="", suffix=""),
     gate="string")
_add("convert_to_datetime", dates.convert_to_datetime, "Convert a column to timestamps",
     {"column": _COLUMN, "format": _optional("string", "strptime format")},
     _says("Read '{column}' as time stamps in format {format}.", format="auto"), fit=_fit_dates)
_add("extract_date_part", dates.extract_date_part, "Take one part out of a date",
     {"column": _COLUMN, "part": _choice(*dates.PARTS), "new_column": _NEW},
     _says("Take the {part} out of '{column}'."), fit=_fit_dates)
_add("offset_date", dates.offset_date, "Shift a date column",
     {"column": _COLUMN, "value": Arg("integer"), "unit": _choice(*dates.OFFSET_UNITS),
      "new_column": _NEW},
     _says("Move '{column}' by {value} {unit}."), fit=_fit_dates)
_add("date_difference", dates.date_difference, "Time from a date column to a reference date",
     {"column": _COLUMN, "reference_date": _optional("string", "'today' or a date"),
      "unit": _choice(*dates.DIFFERENCE_UNITS, required=False), "new_column": _NEW},
     _says("Measure the {unit} from '{column}' to {reference_date}.",
           unit="days", reference_date="today"), fit=_fit_dates)
_add("convert_column_type", types.convert_column_type, "Convert a column to a logical type",
     {"column": _COLUMN, "target_type": _choice(*types.TARGETS)},
     _says("Turn '{column}' into {target_type} values."), fit=_fit_type)
_add("deduplicate_rows", rows.deduplicate_rows, "Remove duplicate rows",
     {"subset": _optional("array"), "keep": _choice(*rows.KEEP, required=False)}, _say_dedup)
_add("drop_column", columns.drop_column, "Remove a column", {"column": _COLUMN},
     _says("Leave out '{column}'."))
_add("rename_column", columns.rename_column, "Rename a column",
     {"column": _COLUMN, "new_name": Arg()}, _says("Call '{column}' '{new_name}' from here on."))
_add("split_column", columns.split_column, "Split a column at a delimiter",
     {"column": _COLUMN, "delimiter": Arg(), "new_columns": _COLUMNS,
      "keep_original": _optional("boolean")},
     _says("Cut '{column}' at each '{delimiter}' into {new_columns}."))
_add("merge_columns", columns.merge_columns, "Join columns into one text column",
     {"columns": _COLUMNS, "separator": Arg(), "new_column": Arg(),
      "drop_original": _optional("boolean")},
     _says("Join {columns} with '{separator}' as '{new_column}'."))
_add("fill_nulls_batch", missing.fill_nulls_batch, "Fill missing values of several columns",
     {"columns": _COLUMNS, "method": _choice(*missing.FILL_METHODS), "value": _ANY},
     _say_fill_batch, fit=_fit_fill_batch, all_columns=data_columns)
_add("trim_spaces_batch", strings.trim_spaces_batch, "Strip white space in several string columns",
     {"columns": _COLUMNS}, lambda a: _says("Cut white space off both ends of {columns}.")(_first_columns(a)),
     all_columns=text_columns)
_add("standardize_case_batch", strings.standardize_case_batch,
     "Bring several string columns to one letter case",
     {"columns": _COLUMNS, "case": _choice(*strings.CASES)},
     lambda a: _says("Write {columns} in {case} case.")(_first_columns(a)),
     all_columns=text_columns)
_add("drop_columns_batch", columns.drop_columns_batch, "Remove several columns",
     {"columns": _COLUMNS}, _says("Leave out {columns}."))
