"""Readers and writers: CSV in any encoding, split-oriented JSON, Parquet, precomputed splits, assignments and metadata."""

from .readers import read_csv, read_edges, read_json_split, read_parquet, read_precomputed
from .writers import write_assignment, write_metadata, write_table, write_wide

__all__ = ["read_csv", "read_edges", "read_json_split", "read_parquet", "read_precomputed", "write_assignment", "write_metadata", "write_table", "write_wide"]
