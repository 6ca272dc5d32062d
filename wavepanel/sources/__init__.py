"""Readers and writers, and the panel export derived from the order tables."""

from .exports import (Exports, duplicate_keys, export_files, guard_key, headers, key_report, load_wide,
                      read_exports)
from .readers import read_export_csv, read_long, table, write_bucketed, write_export_csv, write_long

__all__ = ["table", "read_export_csv", "read_exports", "Exports", "export_files", "headers", "write_export_csv",
           "load_wide", "guard_key", "key_report", "duplicate_keys", "write_long", "read_long", "write_bucketed"]
