"""Cleaning streams: fitted steps, duplicates within a watermark, and files in and out.

Row-wise steps run on a stream as they are. Steps that need statistics of the whole table refuse a
stream unless fitted first on a batch snapshot (``fit_steps``); filling along row order always
refuses it. Duplicates are removed with state that a watermark bounds: either each row goes out when
first seen and its key is remembered for the delay (``drop_repeats``), or one row per key and
window goes out once the window can get no more rows (``one_per_window``), which is the same
row whatever the order of arrival.

``run_available`` reads what is there, writes Parquet, and stops. Its checkpoint remembers what was read and
written, so the next run goes on from there and a run that was cut short adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scrubline.frames import named, require_batch, require_columns, type_of
from scrubline.functions import dates
from scrubline.plans.recipe import execute_tool, fit_steps

__all__ = ["clean_stream", "drop_repeats", "file_stream", "fit_steps", "one_per_window", "run_available"]

TIME = "__event_time"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType | None = None, files_at_once: int | None = None
) -> DataFrame:
    """The Parquet files under ``path`` as a stream, those that come later included."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    # a stream takes the path for a folder unless it is a pattern
    return reader.parquet(f"{path[:-1]}[{path[-1]}]" if _is_file(spark, path) else path)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isFile()


def clean_stream(
    stream: DataFrame, steps: Sequence[Mapping], column_types: Mapping[str, str] | None = None
) -> DataFrame:
    """The cleaned stream; every step must be row-wise or fitted."""
    for step in steps:
        if step["tool_name"] == "deduplicate_rows":
            require_batch(stream, "removing duplicates")
        stream = execute_tool(stream, step, column_types)
    return stream


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with a watermark on ``time``; times without a zone are taken as they stand, whatever the session's."""
    require_columns(stream, [time])
    dtype = type_of(stream, time)
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValueError(f"Column '{time}' holds no times, so it gives no watermark")
    at = named(time) if isinstance(dtype, T.TimestampType) else F.timestamp_micros(dates.epoch_micros(named(time)))
    return stream.withColumn(TIME, at).withWatermark(TIME, delay)


def drop_repeats(stream: DataFrame, subset: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each row of a key when first seen; repeats of the key up to ``delay`` later are dropped.

    For rows delivered more than once. Rows later than the watermark are dropped as well. State holds the
    keys of the last ``delay`` only.
    """
    require_columns(stream, subset)
    return _timed(stream, time, delay).dropDuplicatesWithinWatermark(list(subset)).drop(TIME)


def one_per_window(
    stream: DataFrame,
    subset: Sequence[str],
    time: str,
    window: str,
    delay: str,
    keep: str = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The first or last row of each key in each window of time, once the watermark has passed its end.

    Order is ``time``, then ``order_by``. Copies are combined before the shuffle, so a
    frequent key is no hot spot, and state holds one row per key and open window.
    """
    require_columns(stream, [*subset, *order_by])
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    timed = _timed(stream, time, delay)
    row = F.struct(*[named(c) for c in stream.columns])
    order = F.struct(named(TIME), *[named(c) for c in order_by])
    pick = F.min_by if keep == "first" else F.max_by
    keys = [named(c).alias(f"__k{i}") for i, c in enumerate(subset)]
    picked = timed.groupBy(F.window(TIME, window), *keys).agg(pick(row, order).alias("__row"))
    return picked.select("__row.*")


def run_available(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write all that has arrived to Parquet under ``path``, and return what is there now.

    ``checkpoint`` must be the same folder, which every machine can reach, each time.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
