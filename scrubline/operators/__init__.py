"""Every cleaning operator, callable as ``op(df, ...)`` or with ``df.transform``."""

from scrubline.frames import data_columns, text_columns
from scrubline.operators.columns import (
    create_calculated_column, drop_column, drop_columns_batch, merge_columns, rename_column,
    reorder_columns, split_column,
)
from scrubline.operators.dates import (
    convert_to_datetime, date_difference, extract_date_part, offset_date,
)
from scrubline.operators.missing import drop_rows_with_nulls, fill_nulls, fill_nulls_batch
from scrubline.operators.numbers import (
    apply_math, bin_numeric, clip_numeric, remove_outliers, replace_negative_values, round_numeric,
    scale_numeric,
)
from scrubline.operators.rows import deduplicate_rows, duplicate_count, preview_rows
from scrubline.operators.strings import (
    add_prefix_suffix, pad_string, remove_special_chars, replace_text, replace_text_regex,
    slice_string, standardize_case, standardize_case_batch, trim_spaces, trim_spaces_batch,
)
from scrubline.operators.types import (
    category_codes, category_frame, convert_column_type, convert_columns_batch, encode_categories,
)

__all__ = [
    "add_prefix_suffix", "apply_math", "bin_numeric", "category_codes", "category_frame", "clip_numeric",
    "convert_column_type", "convert_columns_batch", "convert_to_datetime",
    "create_calculated_column", "data_columns", "date_difference", "deduplicate_rows",
    "drop_column", "drop_columns_batch", "drop_rows_with_nulls", "duplicate_count", "encode_categories",
    "extract_date_part", "fill_nulls", "fill_nulls_batch", "merge_columns", "offset_date",
    "pad_string", "preview_rows", "remove_outliers", "remove_special_chars", "rename_column",
    "reorder_columns", "replace_negative_values", "replace_text", "replace_text_regex",
    "round_numeric", "scale_numeric", "slice_string", "split_column", "standardize_case",
    "standardize_case_batch", "text_columns", "trim_spaces", "trim_spaces_batch",
]
