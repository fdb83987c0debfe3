"""Comparing a table before and after a change, row by row on a key."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from scrubline.frames import ROW_ID, count_where, named, require_columns, value

BEFORE, AFTER = "__before", "__after"
SAMPLE = 5

# What is wrong with a key, and over how many tasks' worth of keys rows without one are spread.
FAULT, MISSES, REPEATS = "__fault", 2, 1
SPREAD = 4096

# Columns counted by expressions of their own; more are counted by number.
COLUMNS_COUNTED_APART = 60


def _keys(df: DataFrame, key: str | Sequence[str]) -> list[str]:
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, keys)
    return keys


def packed(df: DataFrame, leave_out: Sequence[str]) -> Column:
    """A row's other columns as one struct that is never null itself."""
    rest = [c for c in df.columns if c not in leave_out]
    return F.struct(F.lit(True).alias("__here"), *[value(df, c).alias(c) for c in rest])


def _missing(df: DataFrame, keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [value(df, c).isNull() for c in keys])


def paired(before: DataFrame, after: DataFrame, key: str | Sequence[str] = ROW_ID) -> DataFrame:
    """Key columns and both versions of each row as structs, null where absent.

    The rows of both sides go through one shuffle, dealt by key and sorted by key and side; each row
    then looks at the row before and the row after it. An old row followed by the new one of its key
    is taken up by that; all others stand alone. ``FAULT`` marks keys that miss or repeat: no
    row is multiplied by them, as a join would, and those without a key are spread over tasks.
    """
    keys = _keys(before, key)
    _keys(after, key)
    old, new = packed(before, keys), packed(after, keys)
    kinds = [df.select(side).schema[0].dataType for df, side in ((before, old.alias("x")), (after, new.alias("x")))]
    spread = F.monotonically_increasing_id() % SPREAD

    def side(df: DataFrame, number: int, a: Column, b: Column) -> DataFrame:
        salt = F.when(_missing(df, keys), spread)
        return df.select(
            *[named(c) for c in keys], a.alias(BEFORE), b.alias(AFTER), F.lit(number).alias("__side"), salt.alias("__salt")
        )

    both = side(before, 0, old, F.lit(None).cast(kinds[1])).union(side(after, 1, F.lit(None).cast(kinds[0]), new))
    by_key = W.partitionBy(*[named(c) for c in keys], "__salt").orderBy("__side")
    last, coming = F.lag("__side").over(by_key), F.lead("__side").over(by_key)
    here = F.col("__side")
    repeats = F.coalesce(last == here, F.lit(False)) | F.coalesce(coming == here, F.lit(False))
    seen = both.select(
        "*", F.lag(BEFORE).over(by_key).alias("__old"), last.alias("__last"), coming.alias("__next"),
        F.when(F.col("__salt").isNotNull(), MISSES).when(repeats, REPEATS).otherwise(0).alias(FAULT),
    )
    taken = (here == 0) & F.coalesce(F.col("__next") == 1, F.lit(False))
    met = (here == 1) & F.coalesce(F.col("__last") == 0, F.lit(False))
    before_row = F.when(met, F.col("__old")).otherwise(F.col(BEFORE))
    return seen.where(~taken | (F.col(FAULT) > 0)).select(
        *[named(c) for c in keys], before_row.alias(BEFORE), AFTER, FAULT
    )


def _refused(keys: Sequence[str], repeat: Column) -> Column:
    kind = F.when(repeat, "keys repeat, so rows cannot be compared: ").otherwise("rows without a key cannot be compared: ")
    return F.concat(kind, F.lit(", ".join(keys)))


def _sound(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs that fail when read if a key repeats or misses; for results that are not counted first."""
    if FAULT not in pairs.columns:
        return pairs
    message = _refused(keys, F.col(FAULT) == REPEATS)
    return pairs.where(F.when(F.col(FAULT) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def _faults(pairs: DataFrame) -> list[Column]:
    """How many rows have each fault, to go into an aggregate over the pairs."""
    fault = F.col(FAULT) if FAULT in pairs.columns else F.lit(0)
    return [count_where(fault == MISSES).alias("misses"), count_where(fault == REPEATS).alias("repeats")]


def _require_sound(pairs: DataFrame, counted) -> None:
    keys = ", ".join(c for c in pairs.columns if c not in (BEFORE, AFTER, FAULT))
    if counted["misses"]:
        raise ValueError(f"rows without a key cannot be compared: {keys}")
    if counted["repeats"]:
        raise ValueError(f"keys repeat, so rows cannot be compared: {keys}")


def _fields(df: DataFrame, side: str) -> list[str]:
    return [f.name for f in df.schema[side].dataType.fields if f.name != "__here"]


def common_columns(pairs: DataFrame) -> list[str]:
    after = set(_fields(pairs, AFTER))
    return [c for c in _fields(pairs, BEFORE) if c in after]


def _changed(pairs: DataFrame, column: str) -> Column:
    """Both null counts as unchanged; only rows on both sides compare."""
    a, b = F.col(BEFORE)[column], F.col(AFTER)[column]
    if pairs.schema[BEFORE].dataType[column].dataType != pairs.schema[AFTER].dataType[column].dataType:
        a, b = _comparable(pairs, column)
    return ~a.eqNullSafe(b)


def _comparable(pairs: DataFrame, column: str) -> tuple[Column, Column]:
    """Two types that changed under a column: numbers as numbers, else text."""
    kinds = [pairs.schema[s].dataType[column].dataType for s in (BEFORE, AFTER)]
    target = "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
    return F.col(BEFORE)[column].cast(target), F.col(AFTER)[column].cast(target)


def _on_both() -> Column:
    return F.col(BEFORE).isNotNull() & F.col(AFTER).isNotNull()


def diff_mask(
    before: DataFrame, after: DataFrame, key: str | Sequence[str] = ROW_ID
) -> DataFrame:
    """One boolean per common cell of every row present on both sides."""
    keys = _keys(before, key)
    pairs = _sound(paired(before, after, key), keys)
    return pairs.where(_on_both()).select(
        *[named(k) for k in keys], *[_changed(pairs, c).alias(c) for c in common_columns(pairs)]
    )


def _counted_apart(pairs: DataFrame) -> tuple[dict, list[int]]:
    """Rows on each side and changed, and the changes per column, by one compiled aggregate."""
    changes = [_on_both() & _changed(pairs, c) for c in common_columns(pairs)]
    any_change = functools.reduce(lambda a, b: a | b, changes, F.lit(False))
    row = pairs.agg(
        F.count(F.col(BEFORE)).alias("before"), F.count(F.col(AFTER)).alias("after"),
        count_where(any_change).alias("rows"), *_faults(pairs),
        *[count_where(change).alias(f"c{i}") for i, change in enumerate(changes)],
    ).first().asDict()
    return row, [row[f"c{i}"] for i in range(len(changes))]


def _counted_by_number(pairs: DataFrame) -> tuple[dict, list[int]]:
    """The same for any number of columns: each pair gives the numbers of what is true of it, which
    are counted before the shuffle, so the plan stays small."""
    columns = common_columns(pairs)
    fault = F.col(FAULT) if FAULT in pairs.columns else F.lit(0)
    flagged = pairs.select(
        F.col(BEFORE).isNotNull().alias("before"), F.col(AFTER).isNotNull().alias("after"),
        (fault == MISSES).alias("misses"), (fault == REPEATS).alias("repeats"),
        F.when(_on_both(), _flags(pairs)).otherwise(F.array().cast("array<boolean>")).alias("flags"),
    )
    names = ["before", "after", "rows", "misses", "repeats"]
    any_change = F.exists("flags", lambda x: x)
    facts = F.concat(F.array("before", "after", any_change, "misses", "repeats"), "flags")
    held = flagged.select(F.posexplode(facts).alias("i", "holds")).where("holds").groupBy("i").count()
    found = dict(held.collect())
    row = {name: found.get(i, 0) for i, name in enumerate(names)}
    return row, [found.get(len(names) + i, 0) for i in range(len(columns))]


def count_pairs(pairs: DataFrame) -> dict:
    """The change counts of paired rows, in one aggregate; keys that miss or repeat are refused."""
    columns = common_columns(pairs)
    before, after = _fields(pairs, BEFORE), _fields(pairs, AFTER)
    few = len(columns) <= COLUMNS_COUNTED_APART
    row, counts = (_counted_apart if few else _counted_by_number)(pairs)
    _require_sound(pairs, row)
    rows_before, rows_after = row["before"], row["after"]
    changed_shape = rows_before != rows_after or len(before) != len(after)
    return {
        "total_cells_changed": None if changed_shape else sum(counts),
        "rows_affected": None if changed_shape else row["rows"],
        "columns_affected": [] if changed_shape else [c for c, n in zip(columns, counts) if n],
        "rows_added": max(0, rows_after - rows_before),
        "rows_removed": max(0, rows_before - rows_after),
        "columns_added": [c for c in after if c not in before],
        "columns_removed": [c for c in before if c not in after],
        "shape_changed": changed_shape,
    }


def count_changes(before: DataFrame, after: DataFrame, key: str | Sequence[str] = ROW_ID) -> dict:
    return count_pairs(paired(before, after, key))


def _flags(pairs: DataFrame) -> Column:
    """For each common column, whether it changed."""
    return F.array(*[_changed(pairs, c) for c in common_columns(pairs)]).cast("array<boolean>")


def _any_changed(pairs: DataFrame) -> Column:
    return F.exists(_flags(pairs), lambda x: x)


def affected_pairs(pairs: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return (
        pairs.where(_on_both() & _any_changed(pairs)).orderBy(*[named(k) for k in keys]).limit(limit)
    )


def affected_rows(
    before: DataFrame, after: DataFrame, key: str | Sequence[str] = ROW_ID, limit: int = 10
) -> tuple[DataFrame, DataFrame]:
    """The first changed rows, before and after; the heads if the shapes differ."""
    keys = _keys(before, key)
    pairs = paired(before, after, key)
    sides = pairs.agg(F.count(F.col(BEFORE)), F.count(F.col(AFTER)), *_faults(pairs)).first()
    _require_sound(pairs, sides)
    if sides[0] != sides[1] or len(before.columns) != len(after.columns):
        order = [named(k) for k in keys]
        return before.orderBy(*order).limit(limit), after.orderBy(*order).limit(limit)
    picked = affected_pairs(pairs, keys, limit)
    return unpacked(picked, keys, BEFORE, before.columns), unpacked(picked, keys, AFTER, after.columns)


def unpacked(pairs: DataFrame, keys: Sequence[str], side: str, columns: Sequence[str]) -> DataFrame:
    return pairs.select(
        *[named(c) if c in keys else F.col(side)[c].alias(c) for c in columns]
    )


def column_pair_counts(pairs: DataFrame, column: str) -> DataFrame:
    """One row: rows on each side, values changed, nulls filled, nulls created, and their sum."""
    a, b = F.col(BEFORE)[column], F.col(AFTER)[column]
    counts = pairs.agg(
        F.count(F.col(BEFORE)).alias("rows_before"),
        F.count(F.col(AFTER)).alias("rows_after"),
        count_where(_on_both() & _changed(pairs, column) & a.isNotNull() & b.isNotNull()).alias("values_changed"),
        count_where(_on_both() & a.isNull() & b.isNotNull()).alias("nulls_filled"),
        count_where(_on_both() & a.isNotNull() & b.isNull()).alias("nulls_created"),
        *_faults(pairs),
    )
    total = F.col("values_changed") + F.col("nulls_filled") + F.col("nulls_created")
    return counts.withColumn("total_changes", total)


def column_changes(
    before: DataFrame, after: DataFrame, column: str, key: str | Sequence[str] = ROW_ID
) -> dict:
    if column not in before.columns or column not in after.columns:
        return {"error": "Column not found in one of the DataFrames"}
    keys = _keys(before, key)
    pairs = paired(
        before.select(*[named(c) for c in dict.fromkeys([*keys, column])]),
        after.select(*[named(c) for c in dict.fromkeys([*keys, column])]),
        key,
    )
    return column_changes_of(pairs, keys, column)


def column_changes_of(pairs: DataFrame, keys: Sequence[str], column: str) -> dict:
    counts = column_pair_counts(pairs, column).first().asDict()
    _require_sound(pairs, counts)
    del counts["misses"], counts["repeats"]
    if counts.pop("rows_before") != counts.pop("rows_after"):
        return {"error": "Row counts differ"}
    sample = (
        pairs.where(_on_both() & _changed(pairs, column))
        .orderBy(*[named(k) for k in keys])
        .select(
            *[named(k) for k in keys],
            F.col(BEFORE)[column].alias("before"),
            F.col(AFTER)[column].alias("after"),
        )
        .head(SAMPLE)
    )
    counts["sample_changes"] = [
        {
            "index": r[keys[0]] if len(keys) == 1 else [r[k] for k in keys],
            "before": "null" if r["before"] is None else r["before"],
            "after": "null" if r["after"] is None else r["after"],
        }
        for r in sample
    ]
    return counts


# The phrases of the one-line change summary.
PHRASES = {
    "rows_removed": "🗑️ {} rows removed",
    "rows_added": "➕ {} rows added",
    "rows_affected": "✏️ {} rows modified",
    "total_cells_changed": "📊 {} cells changed",
    "columns_affected": "📋 Columns: {}",
}
NO_CHANGES = "No changes detected"


def listed(names: Sequence[str], most: int = 3) -> str:
    """The first names and how many more there are."""
    more = f" (+{len(names) - most} more)" if len(names) > most else ""
    return ", ".join(names[:most]) + more


def format_diff_summary(changes: dict) -> str:
    """One line about what changed. Added and removed rows only show when there
    are any; modified rows and cells show whenever they could be counted."""
    shown = {
        "rows_removed": changes.get("rows_removed") or None,
        "rows_added": changes.get("rows_added") or None,
        "rows_affected": changes.get("rows_affected"),
        "total_cells_changed": changes.get("total_cells_changed"),
        "columns_affected": listed(changes.get("columns_affected") or []) or None,
    }
    parts = [PHRASES[k].format(v) for k, v in shown.items() if v is not None]
    return " | ".join(parts) or NO_CHANGES
