"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path, shuffles_dropped
from ..session import setting as _setting

#: A word: a run of anything but ASCII white space, \x20 and \x09-\x0D, which is what \S excludes in Java.
WORD = r"\S+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: For tables whose rows are large: a writer looks at what it holds after each row, not first after 100, and hands on 16 MB.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4",
              "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (with ``options`` of the writer) below the shared checkpoint folder and read it again.

    This computes a shared input once, cuts the lineage, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**(options or {})).parquet(path)
    _opened[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, with the scheme that Spark itself would take for it, for files that
    tasks read and write without Spark's readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


#: Paths of scratch tables, by the ``scratch`` blocks that are open; those outside of any stay.
_opened: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession):
    """The tables that ``written`` writes within the block are deleted at its end: for steps whose result is written
    elsewhere, so that nothing reads them later."""
    _opened.append([])
    try:
        yield
    finally:
        for path in _opened.pop():
            drop_path(spark, path)


def settled(spark: SparkSession, name: str, step) -> DataFrame:
    """What ``step()`` returns, written, without the scratch tables that it took."""
    path = scratch_path(spark, name)
    with scratch(spark):
        out = step()
        with shuffles_dropped(spark):
            out.write.parquet(path)
    _opened[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


#: Keys (rows of a few numbers) up to which a counted table is broadcast.
MAX_BROADCAST_KEYS = 500_000


def keys(df: DataFrame, name: str, entries: Column | None = None) -> DataFrame:
    """``df``, written, and marked for broadcast if its rows, as counted, are within MAX_BROADCAST_KEYS.

    Rows that hold arrays count as many times as ``entries`` says, and once more.
    """
    df = written(df, name)
    size = df.count() if entries is None else df.agg(F.sum(entries.cast("long") + 1)).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST_KEYS else df


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Within it, jobs read and hand Python workers so many rows at a time: for tables whose rows are large.  Results don't depend on it."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), \
            _setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(rows)):
        yield


def let(value: Column, body) -> Column:
    """``body`` over ``value`` as a lambda variable, so that ``value`` is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else (lower() does just that where there is nothing beyond ASCII)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit content address of a row: equal rows share it, a null id or text differs from every other value."""
    parts = [F.col(doc_id), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull()]
    return F.concat_ws(":", F.xxhash64(*parts).cast("string"), F.xxhash64(F.lit(1), *parts).cast("string"))


def merged_runs(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, runs): the maximal runs [start, end) that a key's spans cover, in order; spans that touch become one run.

    Running maxima and sums over the sorted spans, so a key with n spans costs n log n.
    """
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.coalesce(F.max(end).over(upto) >= F.col(start), F.lit(False)), 0).otherwise(1)
    runs = spans.select(key, F.col(start).alias("start"), F.col(end).alias("end"), begins.alias("begins")) \
        .withColumn("run", F.sum("begins").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def fresh(columns: list[str], stem: str) -> str:
    """A column name that is not among ``columns`` (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def sql_string(value: str) -> str:
    return "'" + re.sub("'", "''", value) + "'"


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for the nodes of ``edges``.

    Alternates large-star and small-star steps, each a min-aggregate per node and a join back, and
    writes the edges after each round, until every edge leads from a child with no other edge to its root.
    No component is ever gathered in one place.
    """
    pair = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u"))
    now = written(pair.where("u <> v").distinct(), "cc-edges")
    while _unsettled(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # the edge to the smallest neighbour stays; the others turn into edges from that neighbour
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u") \
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.distinct(), "cc-edges")
    # every node of a component of two or more keeps an edge, so the edges name all nodes
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node of ``edges`` (u, v) has two parents, or a parent and children."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count() > 0
