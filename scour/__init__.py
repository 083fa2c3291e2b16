"""Data-quality analysis and safe cleaning as lazy Spark pipelines."""

from scour.operators.cleaning import clean
from scour.operators.columns import (
    date_format,
    normalize_text,
    remove_units,
    standardize_text,
    standardize_units,
)
from scour.operators.context import dataset_context, find_value_columns
from scour.operators.dedup import drop_duplicates, duplicate_count, remove_duplicates
from scour.operators.missing import drop_missing, fill_categorical, fill_numeric
from scour.operators.profile import (
    analyze_quality,
    display_issues,
    inspect_columns,
    inspect_table,
    profile_report,
)
from scour.operators.rows import (
    drop_columns,
    filter_rows,
    mutate,
    sample_rows,
    select_columns,
    sort_rows,
)
from scour.operators.rules import validation_report, validation_summary, violations
from scour.operators.suggest import suggest
from scour.operators.uniques import (
    approximate_unique,
    estimate_unique,
    merge_sketches,
    unique_sketches,
)
from scour.plans.history import record, replay
from scour.plans.operations import run_operation
from scour.plans.pipeline import apply_pipeline, check_pipeline, run_pipeline
from scour.sources.csv_files import ingest_csv, load_csv, save_table
from scour.sources.inference import safe_infer
from scour.sources.staging import stage, with_row_id

__all__ = [
    "analyze_quality", "apply_pipeline", "approximate_unique", "check_pipeline", "clean",
    "dataset_context", "date_format", "display_issues", "drop_columns", "drop_duplicates",
    "drop_missing", "duplicate_count", "estimate_unique", "fill_categorical", "fill_numeric",
    "filter_rows", "find_value_columns", "ingest_csv", "inspect_columns", "inspect_table",
    "load_csv", "merge_sketches", "mutate", "normalize_text", "profile_report", "record",
    "remove_duplicates", "remove_units", "replay", "run_operation", "run_pipeline",
    "safe_infer", "sample_rows", "save_table", "select_columns", "sort_rows", "stage",
    "standardize_text", "standardize_units", "suggest", "unique_sketches", "validation_report",
    "validation_summary", "violations", "with_row_id",
]
