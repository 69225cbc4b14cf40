"""Event cleaning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.functions.columns import epoch_ms_to_timestamp, event_weight
from clickrank.schemas import DEFAULT_WEIGHTS, VALID_EVENTS

SOURCE_COLUMNS = ["timestamp", "visitorid", "event", "itemid", "transactionid"]


REQUIRED = ("visitorid", "itemid", "timestamp")


def clean_events(df: DataFrame, weights: Mapping[str, float] | None = None, tasks: int | None = None) -> DataFrame:
    """One filter, one de-duplication on the five keys, one projection.

    A row counts if its required fields are there and its type is both valid and
    weighted.  Equal rows collapse in one hash aggregate (NULL transaction ids compare
    equal), copies within a map task before the shuffle.  With ``tasks`` the rows go to so many tasks, for inputs whose
    rows would grow out of the session's; they are dealt by visitor and item, which also serves the sums over these pairs.
    """
    weights = DEFAULT_WEIGHTS if weights is None else weights
    counted = [e for e in VALID_EVENTS if e in weights]
    usable = F.col("event").isin(counted)
    for name in REQUIRED:
        usable = usable & F.col(name).isNotNull()
    moment = epoch_ms_to_timestamp("timestamp")
    rows = df.where(usable).select(*SOURCE_COLUMNS)
    if tasks:
        rows = rows.repartition(tasks, "visitorid", "itemid")
    return rows.distinct().select(
        *SOURCE_COLUMNS, event_weight("event", weights).alias("event_weight"),
        moment.alias("event_ts"), F.to_date(moment).alias("event_date"))
