"""Writing tables and reports. Tables are written by all tasks in parallel as
a folder of part files; only reports, small by nature, become one file."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from scrubline.frames import ROW_ID
from scrubline.plans.report import Quality, report_frame, summary_frame

# Default output names.
OUTPUT_DIR = "outputs"
REPORT_JSON = "data_quality_report.json"
SUMMARY_CSV = "column_summary.csv"
SUMMARY_TXT = "executive_summary.txt"
CLEANED_CSV = "cleaned_data.csv"
CLEANED_PARQUET = "cleaned_data.parquet"
CLEANED_JSON = "cleaned_data.json"
COMPARISON = "data_comparison"


def _path(output_dir: str, name: str) -> str:
    return f"{output_dir.rstrip('/')}/{name}"


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID)


def export_to_csv(df: DataFrame, filename: str = CLEANED_CSV, output_dir: str = OUTPUT_DIR) -> str:
    path = _path(output_dir, filename)
    (
        _plain(df).write.mode("overwrite").option("header", True).option("emptyValue", "")
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    )
    return path


def export_to_parquet(
    df: DataFrame, filename: str = CLEANED_PARQUET, output_dir: str = OUTPUT_DIR
) -> str:
    path = _path(output_dir, filename)
    _plain(df).write.mode("overwrite").parquet(path)
    return path


def export_to_json(df: DataFrame, filename: str = CLEANED_JSON, output_dir: str = OUTPUT_DIR) -> str:
    """One JSON record per line, nulls written out."""
    path = _path(output_dir, filename)
    _plain(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def _write_text(spark: SparkSession, text: str, path: str) -> str:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def export_report_json(spark: SparkSession, report: Mapping, output_dir: str = OUTPUT_DIR) -> str:
    """The nested report as one JSON document."""
    text = json.dumps(report, indent=2, default=str, ensure_ascii=False)
    return _write_text(spark, text, _path(output_dir, REPORT_JSON))


def export_report_table(spark: SparkSession, report: Mapping, path: str) -> str:
    """The report as rows, for querying."""
    frame = report_frame(spark, report)
    frame.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def export_column_summary_csv(
    spark: SparkSession, summary: list[dict], output_dir: str = OUTPUT_DIR
) -> str:
    path = _path(output_dir, SUMMARY_CSV)
    summary_frame(spark, summary).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def export_executive_summary_txt(spark: SparkSession, text: str, output_dir: str = OUTPUT_DIR) -> str:
    return _write_text(spark, text, _path(output_dir, SUMMARY_TXT))


def export_quality(spark: SparkSession, quality: Quality, output_dir: str = OUTPUT_DIR) -> list[str]:
    """Report, column summary and text of one run."""
    return [
        export_report_json(spark, quality.report, output_dir),
        export_column_summary_csv(spark, quality.summary, output_dir),
        export_executive_summary_txt(spark, quality.text, output_dir),
    ]


def comparison_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Five (Metric, Value) rows comparing the sizes of two tables."""
    rows_before, rows_after = before.count(), after.count()
    rows = [
        ("Original Rows", rows_before),
        ("Cleaned Rows", rows_after),
        ("Rows Changed", abs(rows_before - rows_after)),
        ("Original Columns", len(_plain(before).columns)),
        ("Cleaned Columns", len(_plain(after).columns)),
    ]
    return before.sparkSession.createDataFrame(rows, "Metric string, Value bigint")


def export_comparison(
    before: DataFrame, after: DataFrame, filename: str = COMPARISON, output_dir: str = OUTPUT_DIR
) -> str:
    """Both tables and their comparison side by side in one folder."""
    path = _path(output_dir, filename)
    export_to_parquet(before, "Original", path)
    export_to_parquet(after, "Cleaned", path)
    comparison_metrics(before, after).coalesce(1).write.mode("overwrite").option("header", True).csv(
        _path(path, "Summary")
    )
    return path
