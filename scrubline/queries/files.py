"""Queries that write a table and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrubline import operators as ops
from scrubline.plans import report
from scrubline.queries.base import CUSTOMERS, EVENTS, MESSY, ORACLES, QUERIES, query, view
from scrubline.queries.reports import _REPORT, _SUMMARY, _TEXT
from scrubline.session import scratch_path
from scrubline.sources import readers, writers

# Texts a CSV reader takes for missing, next to ones it keeps.
_FILED = view(
    "customer",
    "c_custkey",
    "CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null' WHEN 2 THEN ' NA' WHEN 3 THEN 'a \"b\", c' "
    "WHEN 4 THEN '' ELSE c_name END AS name",
    "CASE c_custkey % 5 WHEN 0 THEN 'NaN' ELSE CAST(c_nationkey AS STRING) END AS nation",
    "CASE c_custkey % 2 WHEN 0 THEN 'True' ELSE 'false' END AS active",
    "CASE c_custkey % 3 WHEN 0 THEN '1e3' WHEN 1 THEN ' 2.5' ELSE '-7' END AS score",
)


@query("s1_read_csv", _FILED,
       "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE name END AS name, "
       "CAST(nullif(nation, 'NaN') AS BIGINT) AS nation, active = 'True' AS active, "
       "CAST(trim(score) AS DOUBLE) AS score FROM {t}")
def _read_csv(df):
    path = scratch_path(df.sparkSession, "csv")
    df.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(df.sparkSession, path)


QUERIES["s2_read_parquet"] = lambda spark, folder: readers.read_parquet(
    spark, f"{folder}/events.parquet", row_id=True).select("event_id", "value", "_row_id")
ORACLES["s2_read_parquet"] = (
    "SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS _row_id FROM events"
)


def _folder(df, kind):
    return scratch_path(df.sparkSession, kind)


@query("s3_csv_sink", CUSTOMERS,
       "SELECT c_custkey, nullif(c_name, '') AS c_name, nullif(c_mktsegment, '') AS c_mktsegment, c_acctbal FROM {t}")
def _csv(df):
    path = writers.export_to_csv(df, output_dir=_folder(df, "out"))
    return readers.read_csv(df.sparkSession, path)


query("s4_parquet_sink", EVENTS, "SELECT * FROM {t}")(
    lambda df: readers.read_parquet(
        df.sparkSession, writers.export_to_parquet(df, output_dir=_folder(df, "out"))))

query("s5_json_sink", CUSTOMERS, "SELECT * FROM {t}")(
    lambda df: df.sparkSession.read.schema(df.schema).json(
        writers.export_to_json(df, output_dir=_folder(df, "out"))))


@query("s6_report_sink", MESSY, _REPORT + "SELECT * FROM r")
def _report(df):
    spark = df.sparkSession
    found = report.run_quality_checks(df)
    path = writers.export_report_table(spark, found.report, _folder(df, "report"))
    return spark.read.schema(report.REPORT_SCHEMA).json(path)


@query("s7_summary_sink", MESSY, _SUMMARY)
def _summary(df):
    spark = df.sparkSession
    found = report.run_quality_checks(df)
    path = writers.export_column_summary_csv(spark, found.summary, _folder(df, "out"))
    return spark.read.schema(report.SUMMARY_SCHEMA).option("header", True).csv(path)


@query("s8_text_sink", MESSY, _TEXT)
def _text(df):
    spark = df.sparkSession
    found = report.run_quality_checks(df)
    path = writers.export_executive_summary_txt(spark, found.text, _folder(df, "out"))
    return spark.read.text(path, wholetext=True).select(
        F.rtrim("value", F.lit("\n")).alias("summary"))


@query("s9_comparison", EVENTS,
       "SELECT 'Original Rows' AS \"Metric\", count(*) AS \"Value\" FROM {t} UNION ALL "
       "SELECT 'Cleaned Rows', count(value) FROM {t} UNION ALL "
       "SELECT 'Rows Changed', count(*) - count(value) FROM {t} UNION ALL "
       "SELECT 'Original Columns', 5 UNION ALL SELECT 'Cleaned Columns', 5")
def _comparison(df):
    cleaned = ops.drop_rows_with_nulls(df, "value")
    path = writers.export_comparison(df, cleaned, output_dir=_folder(df, "out"))
    return df.sparkSession.read.schema("Metric string, Value bigint").option("header", True).csv(
        f"{path}/Summary")
