from .files import day_folders, has_data, latest_watermark, list_dirs, newest_day
from .layers import (
    append_partitioned,
    countable,
    countable_versioned,
    merge_versions,
    overwrite,
    read_layer,
    read_since,
    read_versioned,
    settle,
    write_versioned,
)
from .relational import append_table, read_table
from .schema_store import accept_schema, stored_schema
from .topics import from_topic, read_topic, stream_topic, to_messages, write_topic
from .csv import csv_rejects, read_csv_dimension

__all__ = [
    "accept_schema", "append_partitioned", "append_table", "countable", "countable_versioned", "csv_rejects", "day_folders", "from_topic", "has_data", "latest_watermark", "list_dirs",
    "merge_versions", "newest_day",
    "overwrite", "read_csv_dimension", "read_layer", "read_since", "read_table", "read_topic", "read_versioned",
    "settle", "stored_schema", "stream_topic", "to_messages", "write_topic", "write_versioned",
]
