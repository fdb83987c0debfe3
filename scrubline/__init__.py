"""scrubline: data-quality checks and cleaning for Spark tables."""

from scrubline.frames import ROW_ID
from scrubline.plans.recipe import CleaningLog, apply_steps, execute_tool, fit_steps, preview_step
from scrubline.plans.report import run_quality_checks
from scrubline.plans.suggest import generate_suggestions
from scrubline.session import build_session
from scrubline.sources.readers import read_csv, read_parquet

__all__ = [
    "ROW_ID", "CleaningLog", "apply_steps", "build_session", "execute_tool", "fit_steps",
    "generate_suggestions", "preview_step", "read_csv", "read_parquet", "run_quality_checks",
]
