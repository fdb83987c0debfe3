"""Queries over streams: ``events`` arrives as files, results are what the sink holds afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrubline import streaming
from scrubline.queries.base import EVENTS, ORACLES, QUERIES
from scrubline.session import scratch_path

_STEPS = [
    {"tool_name": "fill_nulls", "arguments": {"column": "value", "method": "median"}},
    {"tool_name": "fill_nulls", "arguments": {"column": "event_type", "method": "mode"}},
    {"tool_name": "standardize_case", "arguments": {"column": "event_type", "case": "upper"}},
]
_TYPES = {"value": "numeric", "event_type": "string"}


def _arriving(spark: SparkSession, folder: str, *expressions: str) -> DataFrame:
    return streaming.file_stream(spark, f"{folder}/events.parquet").selectExpr(*(expressions or EVENTS.expressions))


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    return streaming.run_available(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    fitted = streaming.fit_steps(EVENTS.read(spark, folder), _STEPS, _TYPES)
    return _run(streaming.clean_stream(_arriving(spark, folder), fitted, _TYPES), "cleaned")


QUERIES["st_clean_events"] = _clean
ORACLES["st_clean_events"] = (
    "SELECT event_id, ts, user_id, coalesce(value, (SELECT median(value) FROM {t})) AS value, "
    "upper(coalesce(event_type, (SELECT event_type FROM {t} WHERE event_type IS NOT NULL GROUP BY event_type "
    "ORDER BY count(*) DESC, event_type LIMIT 1))) AS event_type FROM {t}"
).replace("{t}", EVENTS.sql)


def _repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is delivered one to three times."""
    delivered = _arriving(spark, folder, "event_id", "ts", "user_id", "event_type", "value")
    times = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
    delivered = delivered.select("*", times.alias("delivery")).drop("delivery")
    return _run(streaming.drop_repeats(delivered, ["event_id"], "ts", "1 day"), "deduplicated")


QUERIES["st_dedup_events"] = _repeats
ORACLES["st_dedup_events"] = "SELECT event_id, ts, user_id, event_type, value FROM events"

# Closed windows only: those whose end the latest time less the delay has reached.
_PER_DAY = (
    "SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, "
    "event_type, date_trunc('day', ts) ORDER BY ts {order}, event_id {order}) AS n FROM events) WHERE n = 1 AND "
    "date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOUR"
)
for _keep, _order in (("first", ""), ("last", "DESC")):
    QUERIES[f"st_dedup_window_{_keep}"] = lambda spark, folder, keep=_keep: _run(
        streaming.one_per_window(
            _arriving(spark, folder, "event_id", "ts", "user_id", "event_type", "value"),
            ["user_id", "event_type"], "ts", "1 day", "2 hours", keep, ["event_id"]),
        f"{keep}-of-day")
    ORACLES[f"st_dedup_window_{_keep}"] = _PER_DAY.format(order=_order)
