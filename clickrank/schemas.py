"""Fixed schemas of the source files and of the derived tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The valid event types, in this order.
VALID_EVENTS = ("view", "addtocart", "transaction")

# Default implicit-feedback weight per event type.
DEFAULT_WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}

# Default relevant and fallback relevant event types.
DEFAULT_RELEVANT = ("addtocart", "transaction")
DEFAULT_FALLBACK_RELEVANT = ("view", "addtocart", "transaction")

EVENTS_SCHEMA = StructType(
    [
        StructField("timestamp", LongType(), True),  # epoch milliseconds
        StructField("visitorid", IntegerType(), True),
        StructField("event", StringType(), True),
        StructField("itemid", IntegerType(), True),
        StructField("transactionid", StringType(), True),
    ]
)

ITEM_PROPERTIES_SCHEMA = StructType(
    [
        StructField("timestamp", LongType(), True),
        StructField("itemid", IntegerType(), True),
        StructField("property", StringType(), True),
        StructField("value", StringType(), True),
    ]
)

CATEGORY_TREE_SCHEMA = StructType(
    [
        StructField("categoryid", IntegerType(), True),
        StructField("parentid", IntegerType(), True),
    ]
)

CLEAN_EVENTS_SCHEMA = StructType(
    EVENTS_SCHEMA.fields
    + [
        StructField("event_weight", DoubleType(), True),
        StructField("event_ts", TimestampType(), True),
        StructField("event_date", DateType(), True),
    ]
)

INTERACTIONS_COLUMNS = ("visitorid", "itemid", "score", "event_count", "last_event_ts")

RECOMMENDATIONS_SCHEMA = StructType(
    [
        StructField("visitorid", IntegerType(), True),
        StructField("recommendations", ArrayType(IntegerType()), True),
    ]
)

# Long form of a list: one row per (user, position).
RECS_LONG_COLUMNS = ("visitorid", "rank", "itemid")
