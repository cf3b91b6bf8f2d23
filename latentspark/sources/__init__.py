"""Readers and the shared scratch folder."""

from latentspark.sources.tables import materialise, read_csv, read_table, shared_dir, sentinel_to_null

__all__ = ["materialise", "read_csv", "read_table", "shared_dir", "sentinel_to_null"]
