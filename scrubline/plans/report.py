"""The quality report: checks, per-column summary, health score, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrubline.frames import data_columns
from scrubline.operators import checks

# Score bands and the words for them.
STATUSES = [(85, "Healthy ✅"), (60, "Needs Attention ⚠️"), (0, "High Risk ❌")]
HIGH_MISSING_PCT = 30
WORST_COLUMNS = 3

# Sections of a report that list issues per column, and their summary column.
ISSUE_SECTIONS = {
    "type_parsing": "type_issues",
    "string_quality": "string_issues",
    "numeric_validity": "numeric_issues",
    "outliers": "outlier_issues",
}
# Shares are shown next to a count and are not issues themselves.
_SHARES = ("outlier_pct", "missing_pct")

REPORT_SCHEMA = "check string, column string, metric string, value double, flag boolean"
SUMMARY_SCHEMA = (
    "column string, inferred_type string, missing_pct double, missing_count bigint, "
    "type_issues bigint, string_issues bigint, numeric_issues bigint, outlier_issues bigint, "
    "issue_score bigint"
)


def build_report(df: DataFrame, column_types: Mapping[str, str] | None = None) -> dict:
    """Every check of a table. Types are inferred unless given."""
    wants = (checks.TYPES, checks.CONTENT)
    scan = checks.scan_columns(df, wants)
    inferred = checks.types_from(df, scan)
    types = {c: (column_types or {}).get(c, inferred[c]) for c in data_columns(df)}
    present = {c: counts["present"] for c, counts in scan.items()}
    return {
        "dataset_level": checks.dataset_level_checks(df),
        "completeness": checks.completeness_from(scan),
        "column_types": types,
        "type_parsing": checks.parsing_from(scan, types),
        "string_quality": checks.strings_from(scan),
        "numeric_validity": checks.validity_from(scan),
        "outliers": checks.outlier_checks(df, present),
    }


def _issues(found: Mapping[str, object], flag_weight: int) -> int:
    """Counts add up; a true flag weighs ``flag_weight``."""
    total = 0
    for metric, n in found.items():
        if metric not in _SHARES:
            total += flag_weight * n if isinstance(n, bool) else n
    return total


def column_summary(report: Mapping) -> list[dict]:
    """One row of issue counts per column, worst first, column order on ties."""
    rows = []
    for column, kind in report["column_types"].items():
        missing = report["completeness"].get(column, {})
        row = {
            "column": column,
            "inferred_type": kind,
            "missing_pct": missing.get("missing_pct", 0.0),
            "missing_count": missing.get("missing_count", 0),
        }
        for section, name in ISSUE_SECTIONS.items():
            row[name] = _issues(report.get(section, {}).get(column, {}), flag_weight=1)
        row["issue_score"] = row["missing_count"] + sum(row[n] for n in ISSUE_SECTIONS.values())
        rows.append(row)
    return sorted(rows, key=lambda r: (-r["issue_score"], -r["missing_pct"]))


def dataset_health(report: Mapping, summary: list[dict]) -> dict:
    """Score from 0 to 100: the share of cells without an issue.

    Here a true flag condemns the column in every row.
    """
    level = report["dataset_level"]
    rows = level["row_count"]
    cells = max(rows * level["column_count"], 1)
    penalty = level["duplicate_rows"] + level["fully_empty_rows"]
    penalty += sum(r["missing_count"] for r in summary)
    for section in ISSUE_SECTIONS:
        penalty += sum(_issues(found, rows) for found in report.get(section, {}).values())
    score = max(0, 100 - int(penalty / cells * 100))
    return {"score": score, "status": next(s for least, s in STATUSES if score >= least)}


def executive_summary(report: Mapping, health: Mapping, summary: list[dict]) -> str:
    level = report["dataset_level"]
    lines = [
        f"Dataset Health: {health['status']} (Score: {health['score']}/100)",
        f"Rows: {level['row_count']}, Columns: {level['column_count']}",
        f"Duplicate rows: {level['duplicate_rows']}",
    ]
    sparse = [r["column"] for r in summary if r["missing_pct"] > HIGH_MISSING_PCT]
    if sparse:
        lines.append(f"High missing data columns: {', '.join(sparse)}")
    worst = [r["column"] for r in summary[:WORST_COLUMNS]]
    lines.append(f"Highest risk columns: {', '.join(worst)}")
    return "\n".join(lines)


@dataclass(frozen=True)
class Quality:
    """A report with its summary and score, as plain values and as tables."""

    report: dict
    summary: list[dict]
    health: dict

    @property
    def text(self) -> str:
        return executive_summary(self.report, self.health, self.summary)

    def report_frame(self, spark: SparkSession) -> DataFrame:
        return report_frame(spark, self.report)

    def summary_frame(self, spark: SparkSession) -> DataFrame:
        return summary_frame(spark, self.summary)


def run_quality_checks(df: DataFrame, column_types: Mapping[str, str] | None = None) -> Quality:
    report = build_report(df, column_types)
    summary = column_summary(report)
    return Quality(report, summary, dataset_health(report, summary))


# ---- tables over a report: a few rows per column of the checked table ----


def report_frame(spark: SparkSession, report: Mapping) -> DataFrame:
    rows = [("dataset_level", None, m, float(v), None) for m, v in report["dataset_level"].items()]
    for section in ("completeness", *ISSUE_SECTIONS):
        for column, found in report.get(section, {}).items():
            for metric, v in found.items():
                number, flag = (None, v) if isinstance(v, bool) else (float(v), None)
                rows.append((section, column, metric, number, flag))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def summary_frame(spark: SparkSession, summary: list[dict]) -> DataFrame:
    """The column summary as a table, worst column first."""
    names = [f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]
    rows = [tuple(float(r[n]) if n == "missing_pct" else r[n] for n in names) for r in summary]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA).coalesce(1)


def summarize_report(report: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Issue counts per column straight from a long report table."""
    counted = ~F.col("metric").isin(*_SHARES, "missing_count")
    size = F.when(F.col("flag"), F.lit(1.0)).otherwise(F.coalesce("value", F.lit(0.0)))
    sums = {
        name: F.sum(F.when((F.col("check") == section) & counted, size).otherwise(0.0))
        for section, name in ISSUE_SECTIONS.items()
    }
    missing = F.sum(F.when(F.col("metric") == "missing_count", F.col("value")).otherwise(0.0))
    share = F.max(F.when(F.col("metric") == "missing_pct", F.col("value")))
    grouped = (
        report.where(F.col("column").isNotNull())
        .groupBy("column")
        .agg(
            share.alias("missing_pct"),
            missing.cast("bigint").alias("missing_count"),
            *[s.cast("bigint").alias(n) for n, s in sums.items()],
        )
    )
    score = F.col("missing_count")
    for name in ISSUE_SECTIONS.values():
        score = score + F.col(name)
    return rank_summary(grouped.withColumn("issue_score", score), columns)


def rank_summary(summary: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Worst column first; on ties in the order of ``columns`` (the table's), else by name."""
    place = [F.array_position(F.array(*map(F.lit, columns)), F.col("column"))] if columns else []
    return summary.orderBy(F.desc("issue_score"), F.desc("missing_pct"), *place, "column")


def high_missing_columns(summary: DataFrame, percent: float = HIGH_MISSING_PCT) -> DataFrame:
    return summary.where(F.col("missing_pct") > percent)


def worst_columns(
    summary: DataFrame, n: int = WORST_COLUMNS, columns: Sequence[str] | None = None
) -> DataFrame:
    return rank_summary(summary, columns).limit(n)
