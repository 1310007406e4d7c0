"""Scans, sinks and schemas."""

from evkit.sources.files import (
    order_breaks,
    present,
    read_scored,
    read_table,
    replace_partitions,
    row_counts,
    write_scored,
    write_sorted,
)

__all__ = [
    "order_breaks",
    "present",
    "read_scored",
    "read_table",
    "replace_partitions",
    "row_counts",
    "write_scored",
    "write_sorted",
]
