"""Whole-table statistics, each found by distributed jobs whose driver result
is a handful of numbers per column.

Operators put these numbers into their plan as constants, so the cleaned table
is a plain projection over its source and a chain of steps stays linear.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scrubline.frames import chunked, count_where, require_batch, type_of, value
from scrubline.functions import dates

# Up to this many rows go to Spark's exact percentile, and up to this many
# between two known values are sorted; either lot fits one task with ease.
PERCENTILE_ROWS = 20_000
SORTED_ROWS = 200_000

# Mergeable quantile sketch: about 0.05 % rank error in 80 KB.
SKETCH_K = 8000
SKETCH_FAN = 256

# A sketch only has to propose values near a rank, for which this many random
# rows do; how far around the rank to look follows from their number.
SKETCHED_ROWS = 250_000
SKETCHED_ROWS_OF_HUGE = 1_000_000
HUGE_ROWS = 25_000_000


# Columns per aggregate: wide tables take several, each reading its own columns.
COLUMNS_PER_SCAN = 48


@dataclass(frozen=True)
class Moments:
    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


def number(df: DataFrame, column: str) -> Column:
    return value(df, column).cast("double")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Count, mean, sample deviation and range of all columns in one job."""
    require_batch(df, "a column statistic")
    found: dict[str, Moments] = {}
    for chunk in chunked(list(columns), COLUMNS_PER_SCAN):
        found |= _moments(df, chunk)
    return found


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    parts = []
    for i, c in enumerate(columns):
        x = number(df, c)
        parts += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
        ]
    row = df.agg(*parts).first()
    return {
        c: Moments(row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], row[f"b{i}"])
        for i, c in enumerate(columns)
    }


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    require_batch(df, "a column mean")
    if not columns:
        return {}
    found: dict[str, float | None] = {}
    for chunk in chunked(list(columns), COLUMNS_PER_SCAN):
        found.update(zip(chunk, df.agg(*[F.avg(number(df, c)) for c in chunk]).first()))
    return found


# ---- exact quantiles ----


@dataclass(frozen=True)
class _Mark:
    """A value of a column, how many rows lie below it and how many equal it.

    The outermost marks of a column have no value and no rows of their own.
    """

    value: float | None
    below: int
    equal: int = 0


@dataclass(frozen=True)
class _Bracket:
    """A wanted rank and the two marks known to lie around it."""

    column: str
    rank: int
    low: _Mark
    high: _Mark

    @property
    def ends(self) -> tuple:
        return self.column, self.low.value, self.high.value

    @property
    def whole(self) -> bool:
        return self.low.value is None and self.high.value is None

    @property
    def inside_from(self) -> int:
        return self.low.below + self.low.equal

    @property
    def inside(self) -> int:
        return self.high.below - self.inside_from

    def settled(self) -> float | None:
        if self.rank < self.inside_from:
            return self.low.value
        return self.high.value if self.rank >= self.high.below else None

    def tightened(self, marks: Sequence[_Mark]) -> _Bracket:
        low, high = self.low, self.high
        for mark in marks:
            if mark.below <= self.rank and mark.below >= low.below + low.equal:
                low = mark
            elif mark.below > self.rank and mark.below < high.below:
                high = mark
        return _Bracket(self.column, self.rank, low, high)

    def is_inside(self, df: DataFrame) -> Column:
        x = number(df, self.column)
        inside = x.isNotNull()
        if self.low.value is not None:
            inside = inside & (x > self.low.value)
        if self.high.value is not None:
            inside = inside & (x < self.high.value)
        return inside

    def rows_inside(self, df: DataFrame) -> Column:
        return F.when(self.is_inside(df), number(df, self.column))


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    counts: Mapping[str, int] | None = None,
    percentile_rows: int = PERCENTILE_ROWS,
    sorted_rows: int = SORTED_ROWS,
) -> dict[str, dict[float, float | None]]:
    """Exact, linearly interpolated quantiles of many columns.

    Columns of at most ``percentile_rows`` values go to Spark's ``percentile``, whose
    value map is then bounded. Longer ones are narrowed instead: a sketch proposes
    values around each wanted rank, a counting scan proves how many rows lie below
    and at them, and only once the rows in between are proven few are those sorted.
    Memory never grows with the table, and the sketch only steers: a poor proposal
    costs a scan, never the result. ``counts`` are the values present per column,
    where already known.
    """
    require_batch(df, "a quantile")
    found: dict[str, dict[float, float | None]] = {}
    for chunk in chunked([c for c in probabilities if probabilities[c]], COLUMNS_PER_SCAN):
        present = counts or dict(zip(chunk, df.agg(*[F.count(number(df, c)) for c in chunk]).first()))
        small = {c: probabilities[c] for c in chunk if present[c] <= percentile_rows}
        large = {c: probabilities[c] for c in chunk if present[c] > percentile_rows}
        found |= _percentiles(df, small)
        found |= _searched(df, large, present, sorted_rows)
    return found


def _percentiles(df, probabilities) -> dict[str, dict[float, float | None]]:
    if not probabilities:
        return {}
    row = df.agg(
        *[
            F.percentile(number(df, c), F.array(*[F.lit(float(p)) for p in wanted]))
            for c, wanted in probabilities.items()
        ]
    ).first()
    return {
        c: dict(zip(wanted, values or [None] * len(wanted)))
        for (c, wanted), values in zip(probabilities.items(), row)
    }


def _searched(df, probabilities, counts, sorted_rows) -> dict[str, dict[float, float]]:
    brackets = []
    for c, wanted in probabilities.items():
        ends = _Mark(None, 0), _Mark(None, counts[c])
        at = [p * (counts[c] - 1) for p in wanted]
        for rank in sorted({f(a) for a in at for f in (math.floor, math.ceil)}):
            brackets.append(_Bracket(c, rank, *ends))
    picked = _order_statistics(df, brackets, sorted_rows)
    found: dict[str, dict[float, float]] = {c: {} for c in probabilities}
    for c, wanted in probabilities.items():
        for p in wanted:
            at = p * (counts[c] - 1)
            low, high = picked[c, math.floor(at)], picked[c, math.ceil(at)]
            found[c][p] = low if low == high else low + (high - low) * (at - math.floor(at))
    return found


def _propose(df: DataFrame, groups: Sequence[Sequence[_Bracket]], seed: int) -> list[list[float]]:
    """Values near the wanted ranks of brackets that share their ends."""
    fewest = min(g[0].inside for g in groups)
    enough = SKETCHED_ROWS if fewest <= HUGE_ROWS else SKETCHED_ROWS_OF_HUGE
    share = min(1.0, enough / fewest)
    rows = df if all(g[0].whole for g in groups) else _only_inside(df, [g[0] for g in groups])
    if share < 1:
        rows = rows.sample(fraction=share, seed=seed)
    # tasks share a few merge groups so that no single task merges every sketch
    sketched = rows.groupBy((F.spark_partition_id() % SKETCH_FAN).alias("g")).agg(
        *[
            F.kll_sketch_agg_double(g[0].rows_inside(df), F.lit(SKETCH_K)).alias(f"k{i}")
            for i, g in enumerate(groups)
        ]
    )
    parts = []
    for i, g in enumerate(groups):
        margin = max(0.001, 2 / math.sqrt(share * g[0].inside))
        around = {
            min(max((b.rank - b.inside_from) / b.inside + d, 0.0), 1.0) for b in g for d in (-margin, margin)
        }
        sketch = F.kll_merge_agg_double(F.col(f"k{i}"), F.lit(SKETCH_K))
        at = F.array(*[F.lit(p) for p in sorted(around)])
        any_rows = F.kll_sketch_get_n_double(sketch) > 0
        parts.append(F.when(any_rows, F.kll_sketch_get_quantile_double(sketch, at)))
    return [values or [] for values in sketched.agg(*parts).first()]


def _count_marks(df: DataFrame, places: Mapping[str, Sequence[float]]) -> dict[str, list[_Mark]]:
    flat = [(c, v) for c, values in places.items() for v in sorted(set(values))]
    marks: dict[str, list[_Mark]] = {c: [] for c in places}
    if flat:
        counted = df.agg(
            *[f for c, v in flat for f in (count_where(number(df, c) < v), count_where(number(df, c) == v))]
        ).first()
        for i, (c, v) in enumerate(flat):
            marks[c].append(_Mark(v, counted[2 * i], counted[2 * i + 1]))
    return marks


def _order_statistics(df, brackets, sorted_rows) -> dict[tuple[str, int], float]:
    answers = {}
    for seed in count():
        answers.update({(b.column, b.rank): b.settled() for b in brackets if b.settled() is not None})
        brackets = [b for b in brackets if b.settled() is None]
        shared: dict[tuple, list[_Bracket]] = {}
        for b in brackets:
            if b.inside > sorted_rows:
                shared.setdefault(b.ends, []).append(b)
        if not shared:
            return {**answers, **_sort_inside(df, brackets)}
        groups = list(shared.values())
        places: dict[str, list[float]] = {}
        for g, values in zip(groups, _propose(df, groups, seed)):
            places.setdefault(g[0].column, []).extend(values)
        marks = _count_marks(df, places)
        brackets = [b.tightened(marks.get(b.column, [])) for b in brackets]


def _only_inside(df: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """The few rows that lie in any of the brackets: sketches and lists are
    built row by row, the filter before them is compiled and pushed down."""
    keep = F.lit(False)
    for b in brackets:
        keep = keep | F.coalesce(b.is_inside(df), F.lit(False))
    return df.where(keep)


def _sort_inside(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Sort the rows between two marks, each lot already counted and small."""
    if not brackets:
        return {}
    lots: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        lots.setdefault(b.ends, []).append(b)
    ends = [lot[0] for lot in lots.values()]
    parts = [F.struct(F.lit(i).alias("lot"), b.rows_inside(df).alias("x")) for i, b in enumerate(ends)]
    inside = _only_inside(df, ends).select(F.inline(F.array(*parts))).where("x is not null")
    ranks = F.array(*[F.array(*[F.lit(b.rank - b.inside_from) for b in lot]) for lot in lots.values()])
    # one group per lot, so that no task holds more than one
    found = (
        inside.groupBy("lot")
        .agg(F.array_sort(F.collect_list("x")).alias("x"))
        .select("lot", F.transform(F.get(ranks, F.col("lot")), lambda at: F.get("x", at)).alias("found"))
        .collect()
    )
    all_lots = list(lots.values())
    return {(b.column, b.rank): v for r in found for b, v in zip(all_lots[r["lot"]], r["found"])}


# ---- most common values ----

# A frequent-items sketch follows this many hashes per column, of which the likeliest are counted.
ITEMS_TRACKED = 8192
ITEMS_PROPOSED = 32

# Up to this many rows a sketch would save nothing.
COUNTED_WHOLE = 5_000_000

# Columns told apart in one plan; only wider tables take more scans.
COLUMNS_PER_COUNT = 400


def top_value(df: DataFrame, column: str) -> tuple[str | None, int]:
    """The most common value as Spark text, lowest among ties, and its count."""
    return top_values(df, [column])[column]


def top_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str | None, int]]:
    """The most common value of each column as Spark text, lowest among ties, and its count.

    Up to ``COUNTED_WHOLE`` rows all values of all columns are counted in one job. Beyond that there are three
    jobs for any number of columns. A sketch of hashes proposes what is frequent; a scan counts
    the values with those hashes exactly, for all columns at once; and where the best of them is more
    frequent than the sketch can have missed, it is proven. What is left, columns in which
    nothing is frequent, are counted whole, again all in one job. Counts are combined before the shuffle, so
    a hot value costs nothing extra, and the sketch never decides the result.
    """
    require_batch(df, "the most common value")
    found: dict[str, tuple[str | None, int]] = {}
    plain = [c for c in columns if _typed(df, c) is not None]
    for c in columns:
        if c not in plain:
            found[c] = _top_by_sorting(df, c)
    small = bool(plain) and df.count() <= COUNTED_WHOLE
    for chunk in chunked(plain, COLUMNS_PER_COUNT):
        if small:
            found |= dict.fromkeys(chunk, (None, 0)) | _top_counted(df, dict.fromkeys(chunk))
            continue
        present, proposed = _proposed(df, chunk)
        counted = _top_counted(df, {c: proposed[c][0] for c in chunk if proposed[c][0]})
        for c in chunk:
            if not present[c]:
                found[c] = (None, 0)
            elif c in counted and counted[c][1] > proposed[c][1]:
                found[c] = counted[c]
        found |= _top_counted(df, {c: None for c in chunk if c not in found})
    return {c: found[c] for c in columns}


def _top_by_sorting(df: DataFrame, column: str) -> tuple[str | None, int]:
    v = value(df, column)
    rows = (
        df.select(v.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("v"))
        .select(F.col("v").cast("string").alias("v"), "n")
        .head(1)
    )
    return (rows[0]["v"], rows[0]["n"]) if rows else (None, 0)


def _typed(df: DataFrame, column: str) -> tuple[str, Column] | None:
    """Where a value goes in a row for all types, in the order of its own type: a whole number, a fraction or a text."""
    dtype, v = type_of(df, column), value(df, column)
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "l", v.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "d", v.cast("double") + F.lit(0.0)
    if isinstance(dtype, T.StringType) and dtype == T.StringType():
        return "s", v
    if isinstance(dtype, T.DateType):
        return "l", F.unix_date(v).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "l", F.unix_micros(v)
    if isinstance(dtype, T.TimestampNTZType):
        return "l", dates.epoch_micros(v)
    return None


def _text_again(df: DataFrame, column: str) -> Column:
    dtype = type_of(df, column)
    if isinstance(dtype, T.DateType):
        back = F.date_from_unix_date(F.col("l").cast("int"))
    elif isinstance(dtype, T.TimestampType):
        back = F.timestamp_micros("l")
    elif isinstance(dtype, T.TimestampNTZType):
        back = dates.from_epoch_micros(F.col("l"))
    else:
        back = F.col(_typed(df, column)[0]).cast(dtype)
    return back.cast("string")


def _proposed(df: DataFrame, columns: Sequence[str]) -> tuple[dict, dict]:
    """Values present per column; and per column the hashes to count and how frequent another value can be at most."""
    hashes = [F.when(value(df, c).isNotNull(), F.xxhash64(_typed(df, c)[1])).alias(f"h{i}") for i, c in enumerate(columns)]
    # tasks share a few merge groups so that no single task merges every sketch
    sketched = df.select(*hashes).groupBy((F.spark_partition_id() % SKETCH_FAN).alias("g")).agg(
        *[F.expr(f"approx_top_k_accumulate(h{i}, {ITEMS_TRACKED})").alias(f"k{i}") for i in range(len(columns))],
        *[F.count(f"h{i}").alias(f"n{i}") for i in range(len(columns))],
    )
    # grouped, as a task without rows would hand on a sketch that cannot be merged
    row = sketched.groupBy(F.col("g") < 0).agg(
        *[
            F.expr(f"approx_top_k_estimate(approx_top_k_combine(k{i}, {ITEMS_TRACKED}), {ITEMS_PROPOSED})").alias(f"k{i}")
            for i in range(len(columns))
        ],
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(columns))],
    ).first()
    present, proposed = {}, {}
    if row is None:
        return dict.fromkeys(columns, 0), {c: ([], 0) for c in columns}
    for i, c in enumerate(columns):
        items, present[c] = row[f"k{i}"] or [], row[f"n{i}"] or 0
        # a value not listed is within twice the sketch's error, or no more frequent than the last one listed
        missed = 7 * present[c] / ITEMS_TRACKED
        if len(items) == ITEMS_PROPOSED:
            missed = max(missed, items[-1]["count"])
        if present[c] <= ITEMS_TRACKED // 2 and len(items) < ITEMS_PROPOSED:
            missed = 0  # every value has its place in the sketch
        proposed[c] = [r["item"] for r in items], missed
    return present, proposed


def _top_counted(df: DataFrame, proposed: Mapping[str, list | None]) -> dict[str, tuple[str, int]]:
    """The most common of the values with the given hashes (None: of all values), of all columns in one job."""
    columns = list(proposed)
    if not columns:
        return {}
    cells = []
    for i, (c, hashes) in enumerate(proposed.items()):
        place, v = _typed(df, c)
        typed = {k: F.lit(None).cast(t) for k, t in (("l", "bigint"), ("d", "double"), ("s", "string"))} | {place: v}
        wanted = v.isNotNull() if hashes is None else F.xxhash64(v).isin(hashes) & v.isNotNull()
        cells.append(F.when(wanted, F.struct(F.lit(i).alias("i"), *[x.alias(k) for k, x in typed.items()])))
    cells = df.select(F.explode(F.array(*cells)).alias("cell")).where("cell is not null").select("cell.*")
    n = F.count("*")
    best = (
        cells.groupBy("i", "l", "d", "s")
        .agg(n.alias("n"))
        .groupBy("i")
        .agg(F.min(F.struct((-F.col("n")).alias("minus"), "l", "d", "s")).alias("best"))
        .select("i", "best.*")
    )
    text = F.coalesce(*[F.when(F.col("i") == i, _text_again(df, c)) for i, c in enumerate(columns)])
    return {columns[r["i"]]: (r["text"], -r["minus"]) for r in best.select("i", "minus", text.alias("text")).collect()}


# ---- range splits ----


def range_splits(df: DataFrame, key: Column, pieces: int) -> list[float]:
    """Inner boundaries that cut a numeric key into pieces of similar size.

    Beyond a few hundred pieces a sketch of the whole is too coarse, so each
    first-level piece is sketched again on its own.
    """
    first = min(pieces, 200)
    keyed = df.select(key.cast("double").alias("k")).where(F.col("k").isNotNull())
    merged = keyed.groupBy((F.spark_partition_id() % SKETCH_FAN).alias("g")).agg(
        F.kll_sketch_agg_double("k", F.lit(SKETCH_K)).alias("s")
    )
    splits = _sketch_cuts(merged.agg(F.kll_merge_agg_double("s", F.lit(SKETCH_K)).alias("s")), first)
    if pieces > first and splits:
        per_piece = math.ceil(pieces / first)
        level = bucket_of(keyed, "k", splits, "b")
        inner = level.groupBy("b").agg(F.kll_sketch_agg_double("k", F.lit(SKETCH_K)).alias("s"))
        splits = sorted({*splits, *_sketch_cuts(inner, per_piece)})
    return splits


def _sketch_cuts(sketches: DataFrame, pieces: int) -> list[float]:
    at = F.array(*[F.lit(i / pieces) for i in range(1, pieces)]) if pieces > 1 else None
    if at is None:
        return []
    rows = sketches.select(
        F.kll_sketch_get_quantile_double("s", at).alias("q")
    ).collect()
    return sorted({x for r in rows if r["q"] for x in r["q"]})


def bucket_of(df: DataFrame, key: str, splits: Sequence[float], name: str) -> DataFrame:
    """Add the number of the range a key falls in (binary search per row)."""
    from pyspark.ml.feature import Bucketizer

    if not splits:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=key, outputCol=name)
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))
