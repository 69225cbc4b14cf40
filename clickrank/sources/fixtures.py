"""Adapters from the driver's tables to the clickstream schema.

``events`` (E) and ``orders`` joined to ``lineitem`` (O) become event logs
with the five source columns; ``part`` becomes an item-property log and
``nation``/``region`` a two-level category tree.  Ids are cast to int (the
user sampler's hash and ALS both depend on it); times become epoch
milliseconds in the UTC session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.operators.split import DEFAULT_ROWS_PER_TASK, ROWS_PER_TASK_CONF

# Event type of the events table -> clickstream event.
EVENTS_TYPE_MAP = {"view": "view", "click": "addtocart", "purchase": "transaction"}

# Lineitem return flag -> clickstream event.
RETURNFLAG_EVENT_MAP = {"N": "view", "A": "addtocart", "R": "transaction"}

# Part columns unpivoted into item properties.
PART_PROPERTIES = {"brand": "p_brand", "type": "p_type", "size": "p_size"}

FIXTURES = ("events", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_tasks(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """The tasks that a fixture's events are dealt over, so that a task's rows don't grow with the input: one for each
    ROWS_PER_TASK_CONF rows, as counted from the files' footers, or None where that is no more than the cores."""
    rows = table(spark, sf_dir, "lineitem" if name == "orders" else "events").count()
    tasks = -(-rows // int(spark.conf.get(ROWS_PER_TASK_CONF, str(DEFAULT_ROWS_PER_TASK))))
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def _epoch_ms(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def _mapped(col: str, mapping: dict[str, str], keep_unmapped: bool) -> Column:
    expr = None
    for source, target in mapping.items():
        expr = (F.when(F.col(col) == source, F.lit(target)) if expr is None
                else expr.when(F.col(col) == source, F.lit(target)))
    return expr.otherwise(F.col(col) if keep_unmapped else F.lit(None).cast("string"))


def events_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: the events table as a clickstream; signup/error stay (invalid) events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        _epoch_ms("ts").alias("timestamp"),
        F.col("user_id").cast("int").alias("visitorid"),
        _mapped("event_type", EVENTS_TYPE_MAP, keep_unmapped=True).alias("event"),
        F.get_json_object("props", "$.k").try_cast("int").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("transactionid"),
    )


def orders_fixture(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """O: every line item is an event of the order's customer on the part; joined in ``tasks`` tasks if given."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    if tasks:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        _epoch_ms("o_orderdate").alias("timestamp"),
        F.col("o_custkey").cast("int").alias("visitorid"),
        _mapped("l_returnflag", RETURNFLAG_EVENT_MAP, keep_unmapped=True).alias("event"),
        F.col("l_partkey").cast("int").alias("itemid"),
        F.when(
            F.col("l_returnflag") == "R",
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        ).alias("transactionid"),
    )


def dirty_events_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-dirty: E with exact duplicate rows and missing item ids injected.

    Every row of E is kept; rows with event_id % 10 = 0 appear twice and rows
    with event_id % 13 = 0 lose their itemid, so cleaning has work to do.
    """
    ev = table(spark, sf_dir, "events")
    doubled = ev.withColumn(
        "copies", F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    ).select("*", F.explode("copies").alias("copy"))
    return doubled.select(
        _epoch_ms("ts").alias("timestamp"),
        F.col("user_id").cast("int").alias("visitorid"),
        _mapped("event_type", EVENTS_TYPE_MAP, keep_unmapped=True).alias("event"),
        F.when(F.col("event_id") % 13 != 0, F.get_json_object("props", "$.k").try_cast("int")).alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("transactionid"),
    )


def fixture_events(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    if name == "events":
        return events_fixture(spark, sf_dir)
    if name == "orders":
        return orders_fixture(spark, sf_dir, tasks)
    if name == "events_dirty":
        return dirty_events_fixture(spark, sf_dir)
    raise ValueError(f"unknown fixture {name!r}")


def item_properties_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-property log from ``part``: one (itemid, property, value) per attribute."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("itemid"),
        *[F.col(src).cast("string").alias(prop) for prop, src in PART_PROPERTIES.items()],
    )
    long = part.unpivot("itemid", list(PART_PROPERTIES), "property", "value")
    return long.select(F.lit(0).cast("long").alias("timestamp"), "itemid", "property", "value")


def category_tree_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category tree: nations are leaves 100 + n_nationkey under their region; regions are roots."""
    nations = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("int").alias("categoryid"),
        F.col("n_regionkey").cast("int").alias("parentid"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("categoryid"),
        F.lit(None).cast("int").alias("parentid"),
    )
    return nations.unionByName(regions)
