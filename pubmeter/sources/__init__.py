"""Scans and sinks."""

from pubmeter.sources.files import (
    chunked_parquet,
    read_delimited,
    read_numbered_files,
    read_parquet,
    read_row_partitions,
    temp_view,
    write_csv,
    write_parquet,
    write_row_partitions,
    write_tables,
)

__all__ = [
    "chunked_parquet",
    "read_delimited",
    "read_numbered_files",
    "read_parquet",
    "read_row_partitions",
    "temp_view",
    "write_csv",
    "write_parquet",
    "write_row_partitions",
    "write_tables",
]
