"""Readers into the canonical ratings schema, run-log readers and sinks."""

from ratewright.sources.ratings import (
    ParsedFolds,
    ParsedRatings,
    parse_ratings,
    read_double_colon,
    read_fold,
    read_folds,
    read_header_csv,
    read_parquet,
    read_tab,
)
from ratewright.sources.runlog import run_log_frame
from ratewright.sources.sinks import (
    read_bucketed,
    write_bucketed,
    write_json,
    write_parquet,
    write_single_csv,
)
from ratewright.sources.workspace import checkpoint_folder, work_path

__all__ = [
    "ParsedFolds",
    "ParsedRatings",
    "checkpoint_folder",
    "parse_ratings",
    "read_bucketed",
    "read_double_colon",
    "read_fold",
    "read_folds",
    "read_header_csv",
    "read_parquet",
    "read_tab",
    "run_log_frame",
    "work_path",
    "write_bucketed",
    "write_json",
    "write_parquet",
    "write_single_csv",
]
