"""Sources, sinks and driver-table adapters."""

from clickrank.sources.files import (
    profile_as_key_values,
    read_category_tree,
    read_events,
    read_item_properties,
    read_parquet,
    write_csv,
    write_metrics_csv,
    write_parquet,
    write_profile,
)
from clickrank.sources.fixtures import (
    category_tree_fixture,
    dirty_events_fixture,
    events_fixture,
    fixture_events,
    item_properties_fixture,
    orders_fixture,
    table,
)

__all__ = [
    "category_tree_fixture",
    "dirty_events_fixture",
    "events_fixture",
    "fixture_events",
    "item_properties_fixture",
    "orders_fixture",
    "profile_as_key_values",
    "read_category_tree",
    "read_events",
    "read_item_properties",
    "read_parquet",
    "table",
    "write_csv",
    "write_metrics_csv",
    "write_parquet",
    "write_profile",
]
