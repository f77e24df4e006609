"""Readers for stored tables, as batches or as streams."""

from frostgrid.sources.tables import read_table, stream_table, table_path

__all__ = ["read_table", "stream_table", "table_path"]
