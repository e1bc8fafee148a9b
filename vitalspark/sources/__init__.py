"""Sources: declared schemas, CSV/Parquet readers, and the event-log adapter."""

from vitalspark.sources.event_log import (
    EventMapping,
    MissingTable,
    TrackerTables,
    load_tracker_tables,
    read_events,
    tracker_tables,
)
from vitalspark.sources.ordered import in_order, manifest, read_ordered, write_ordered
from vitalspark.sources.readers import TableRead, load_table, read_table, read_tables, reject_counts
from vitalspark.sources.schemas import SCHEMAS

__all__ = [
    "EventMapping",
    "MissingTable",
    "SCHEMAS",
    "TableRead",
    "TrackerTables",
    "in_order",
    "load_table",
    "load_tracker_tables",
    "manifest",
    "read_events",
    "read_ordered",
    "read_table",
    "read_tables",
    "reject_counts",
    "tracker_tables",
    "write_ordered",
]
