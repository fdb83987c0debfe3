"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.session import scratch_path

#: A batch of texts is worked on in slices of at most this many bytes (or one text).
SLICE_BYTES = 4_000_000

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


#: Removes the shuffle files of an execution when it ends (Spark 4.1).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For ``written`` where single rows are megabytes: Parquet looks at the size of what it holds after each row.
LARGE_ROWS = {
    "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
}


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    Cuts the lineage, so a lost executor repeats no work before this point, and
    fixes values that depend on how tasks were dealt. Its shuffle files are of no more use then, so
    they go at once; the setting for this is put back after the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of bounded text size, each with its texts."""
    sizes = np.array([len(b) for b in batch.column(column).cast(pa.binary()).to_pylist() if b is not None] or [0])
    if sizes.sum() <= most or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch, as_bytes(batch.column(column))
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), column, most)
    yield from slices(batch.slice(half), column, most)


def record(schema: str | None = None, **columns) -> pa.RecordBatch:
    """An Arrow batch of the given columns (arrays, lists or numpy arrays)."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b, the smallest node that each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    return label
