"""Session set-up, and the shared folder that survives a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


def build_session(app_name: str = "scrubline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and the clock in UTC.

    Shuffle width is left to the cluster's own setting (adaptive execution
    coalesces it), so only pass ``spark.sql.shuffle.partitions`` in tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # the call site of every single column expression is not worth its price
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path is unreadable from the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        folder = os.path.join(tempfile.gettempdir(), f"scrubline-{spark.sparkContext.applicationId}")
        os.makedirs(folder, exist_ok=True)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept_by_parquet(schema: T.StructType) -> bool:
    """Whether Parquet can hold every column under its own name."""

    def held(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.StructType):
            names = [f.name.lower() for f in dtype.fields]
            return 0 < len(set(names)) == len(names) and all(held(f.dataType) for f in dtype.fields)
        if isinstance(dtype, T.ArrayType):
            return held(dtype.elementType)
        if isinstance(dtype, T.MapType):
            return held(dtype.keyType) and held(dtype.valueType)
        return not isinstance(dtype, (T.NullType, T.CalendarIntervalType, T.VariantType))

    return held(schema)


def cut_lineage(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    Rows are written as Parquet, so later scans read only the columns they need and skip row groups
    by their filters. Tables that Parquet cannot hold are checkpointed as rows.
    """
    spark = df.sparkSession
    if _kept_by_parquet(df.schema):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
