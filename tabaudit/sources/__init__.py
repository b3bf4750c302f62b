"""Reading, checking and storing tables."""

from tabaudit.sources.contracts import Contract, check_contract
from tabaudit.sources.readers import (
    preview,
    quarantine_counts,
    read_csv_quarantined,
    read_csv_typed,
    read_parquet_tables,
    select_scope,
)
from tabaudit.sources.storage import bucket_count, materialize, materialize_temporary, read_current, replace_table

__all__ = [
    "Contract",
    "bucket_count",
    "check_contract",
    "materialize",
    "materialize_temporary",
    "preview",
    "quarantine_counts",
    "read_csv_quarantined",
    "read_csv_typed",
    "read_current",
    "read_parquet_tables",
    "replace_table",
    "select_scope",
]
