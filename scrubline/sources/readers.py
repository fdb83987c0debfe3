"""Reading tables, with missing values normalised and row order on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scrubline.frames import ROW_ID, clean_nan, count_where, named
from scrubline.functions import numbers
from scrubline.session import cut_lineage

# CSV texts that mean a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# CSV texts that mean a truth value.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# File tables up to this many rows are broadcast to number the rows.
BROADCAST_FILES = 200_000

_WHOLE = r"^\s*[+-]?\d+\s*$"
_PLACE = ["__file", "__block"]


def read_parquet(spark: SparkSession, path: str | list[str], row_id: bool = False) -> DataFrame:
    """A Parquet table; ``row_id`` adds each row's position in file order."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    if not row_id:
        return clean_nan(df)
    placed = df.select(
        *[named(c) for c in df.columns],
        F.col("_metadata.file_path").alias("__file"),
        F.lit(0).cast("bigint").alias("__block"),
        F.col("_metadata.row_index").alias("__at"),
    )
    # counting rows per file reads footers and no column
    sizes = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("n"))
    return clean_nan(_numbered(placed, sizes.withColumn("__block", F.lit(0).cast("bigint")), len(df.inputFiles())))


def _numbered(placed: DataFrame, sizes: DataFrame, places: int) -> DataFrame:
    """Dense positions: rows before this file or block, plus the place inside.

    The running total goes over one row per file, not over the data.
    """
    before = Window.partitionBy(F.lit(0)).orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*_PLACE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    if places <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    joined = placed.join(starts, _PLACE)
    data = [c for c in placed.columns if c not in (*_PLACE, "__at")]
    return joined.select(
        *[named(c) for c in data], (F.col("__start") + F.col("__at")).cast("bigint").alias(ROW_ID)
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    row_id: bool = False,
    narrow: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """A CSV table with header: missing-value texts become null, and columns get
    the narrowest type all their values fit.

    ``row_id`` adds positions in file order. They depend on where Spark splits
    the files, so the rows are written to the shared folder once and read on from
    there; later passes then also skip the CSV parsing.
    """
    df = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    columns = df.columns
    cleaned = [F.expr(_without_missing(c)).alias(c) for c in columns]
    if row_id:
        place = [
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__id"),
        ]
        df = cut_lineage(df.select(*cleaned, *place))
        blocks = df.groupBy(*_PLACE).agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
        count = blocks.count()
        firsts = blocks.select(*_PLACE, "__first")
        if count <= BROADCAST_FILES:
            firsts = F.broadcast(firsts)
        placed = df.join(firsts, _PLACE).withColumn("__at", F.col("__id") - F.col("__first"))
        df = _numbered(placed.drop("__id", "__first"), blocks.drop("__first"), count)
    else:
        df = df.select(*cleaned)
    return narrow_types(df, columns) if narrow else df


def _without_missing(column: str) -> str:
    """The column without the texts that mean a missing value; as SQL text, which is one call per column."""
    name = "`" + column.replace("`", "``") + "`"
    return f"CASE WHEN {name} NOT IN ({', '.join(map(repr, NA_TOKENS))}) THEN {name} END"


def narrow_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to whole numbers, numbers or truth values where every
    present value fits; truth values only when none is missing."""
    found = _text_counts(df, columns)
    changed: dict[str, Column] = {}
    for i, c in enumerate(columns):
        rows, present, whole, number, truth = found.get(i, (0,) * 5)
        if not present:
            # a column without any value counts as numeric
            changed[c] = F.lit(None).cast("double")
        elif whole == present:
            changed[c] = named(c).try_cast("bigint")
        elif number == present:
            changed[c] = numbers.parse_number(named(c))
        elif truth == rows:
            changed[c] = named(c).isin(TRUE_TOKENS)
    return df.withColumns(changed) if changed else df


def _text_counts(df: DataFrame, columns: list[str]) -> dict[int, tuple[int, ...]]:
    """Per column number: rows, values present, whole numbers, numbers and truth values.

    The columns become rows of (number, value) inside the scan and are counted before the shuffle, so a
    wide table is parsed once and its plan stays small.
    """
    if not columns:
        return {}
    v = F.col("v")
    counted = (
        df.select(F.posexplode(F.array(*map(named, columns))).alias("i", "v"))
        .groupBy("i")
        .agg(
            F.count("*"), F.count(v), count_where(v.rlike(_WHOLE) & v.try_cast("bigint").isNotNull()),
            F.count(numbers.parse_number(v)), count_where(v.isin(TRUE_TOKENS + FALSE_TOKENS)),
        )
    )
    return {r[0]: tuple(r[1:]) for r in counted.collect()}
