"""Global popularity recommender (A4, L1, L2, M1) on a ranking that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickrank.functions.columns import exact_score
from clickrank.operators.reclist import RecList
from clickrank.operators.skew import hot_keys, key_counts, salted_join
from clickrank.session import scratch_path

#: Ranks of one block: what is gathered of a user at a time.
BLOCK_RANKS = 1024
#: So many of the first ranks are found without ranking every item.
MAX_TOP = 10_000
#: Ranks that are broadcast; a list that lies within them takes no other rank.
TOP_RANKS = 1024


def item_popularity(train: DataFrame) -> DataFrame:
    """A4: summed score per item, as decimal(38,12) so the order is summation-order free."""
    return train.groupBy("itemid").agg(F.sum(exact_score("score")).alias("item_score"))


def popularity_ranks(train: DataFrame) -> DataFrame:
    """L1, whole: (cand_rank, itemid, item_score) of every item, score desc then itemid asc, from 1.

    The items are dealt into ranges of the order and written with the number of their range; the ranges' counts give
    each its offset, and rows are numbered inside each range.  No task sorts more than a range.
    """
    spark = train.sparkSession
    order = [F.desc("item_score"), F.asc("itemid")]
    scores = item_popularity(train)
    path = scratch_path(spark, "popularity-ranges")
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000))
    dealt = scores.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt.write.parquet(path)
    ranged = spark.read.schema(dealt.schema).parquet(path)
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before, offsets = 0, []
    for number in sorted(sizes):
        offsets += [F.lit(number), F.lit(before)]
        before += sizes[number]
    offset = F.create_map(*offsets)[F.col("range")] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.select((place + offset).cast("int").alias("cand_rank"), "itemid", "item_score")


def popular_candidates(train: DataFrame, n: int) -> DataFrame:
    """L1: the global top-n items as (cand_rank, itemid, item_score).

    Up to MAX_TOP, every task hands on its best n and only those are numbered in one place; beyond, all are ranked by ranges.
    """
    if n > MAX_TOP:
        return popularity_ranks(train).where(F.col("cand_rank") <= n)
    order = [F.desc("item_score"), F.asc("itemid")]
    first = item_popularity(train).orderBy(*order).limit(n)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("cand_rank"), "itemid", "item_score")


def first_gaps(seen: DataFrame, k: int, block: int = BLOCK_RANKS) -> DataFrame:
    """(visitorid, rank, cand_rank): the first k positive numbers that are not among a user's ``seen`` (visitorid,
    cand_rank), and their places from 1.

    Ranks are taken by blocks of ``block``.  What is left free by a user's blocks up to one follows from running
    counts, so that only its blocks with some of the first k free ranks are looked into; the runs between the blocks,
    and after the last one, are free as a whole.  A user who has seen half of all ranks is a few numbers for each
    block, never one list.
    """
    blocks = seen.select("visitorid", "cand_rank", F.floor((F.col("cand_rank") - 1) / F.lit(block)).cast("int").alias("block")) \
        .groupBy("visitorid", "block").agg(F.collect_set("cand_rank").alias("held"))  # at most ``block`` ranks
    by_user = Window.partitionBy("visitorid").orderBy("block")
    taken = F.size("held").cast("long")
    before = F.coalesce(F.sum(taken).over(by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = blocks.select("visitorid", "block", "held", (F.col("block").cast("long") * block - before).alias("free"),
                         F.lag("block", 1, -1).over(by_user).alias("last"), F.lead("block").over(by_user).alias("next"))
    # free ranks inside the block; the run of free blocks before it; after the last block, the run that has no end
    start = F.col("block") * block
    inside = F.when(F.col("free") < k, F.slice(F.array_except(F.sequence(start + 1, start + block), "held"), 1, k))
    ahead = F.least(F.lit(k).cast("long"), F.col("free"))
    gap = (start - (F.col("last") + 1) * block).cast("long")
    run = F.when((gap > 0) & (F.col("free") - gap < k), F.transform(
        F.sequence(F.lit(1).cast("long"), F.least(gap, F.lit(k).cast("long") - (F.col("free") - gap))),
        lambda i: ((F.col("last") + 1) * block + i).cast("int")))
    after = F.col("free") + block - F.size("held")
    tail = F.when(F.col("next").isNull() & (after < k), F.transform(
        F.sequence(F.lit(1).cast("long"), F.lit(k) - after), lambda i: (start + block + i).cast("int")))
    pieces = F.array(F.struct((F.col("free") - gap).alias("at"), run.alias("ranks")), F.struct(F.col("free").alias("at"), inside.alias("ranks")),
                     F.struct(after.alias("at"), tail.alias("ranks")))
    out = told.where(F.col("free") - gap < k).select("visitorid", F.explode(pieces).alias("p")).where("p.ranks is not null")
    return out.select("visitorid", "p.at", F.posexplode("p.ranks").alias("pos", "cand_rank")) \
        .select("visitorid", (F.col("at") + F.col("pos") + 1).cast("int").alias("rank"), "cand_rank").where(F.col("rank") <= k)


def whole_history_lists(pairs: DataFrame, ranks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((visitorid, rank, itemid), persisted helper): lists out of the whole ranking, whatever the users have seen.

    The seen items' ranks come from an equi-join (hot items salted), the first unseen ranks of each user from
    ``first_gaps`` over the part of its history that can matter, and their items from an equi-join back (hot ranks
    salted).
    """
    # one small job, which bounds the rows of every join below and so spares small inputs the search for hot keys
    rows, n_users = pairs.agg(F.count(F.lit(1)), F.count_distinct("visitorid")).first()
    held = salted_join(pairs, ranks, "itemid", rows_bound=rows).select("visitorid", "cand_rank").persist()  # counted, then filtered
    # of a user with n seen items, the first k free ranks are among the first n + k; a rank to name the user stays
    need = held.groupBy("visitorid").agg(F.count(F.lit(1)).alias("n"), F.min("cand_rank").alias("least"))
    near = salted_join(held, need, "visitorid", hot=hot_keys(key_counts(pairs, "visitorid"), "visitorid", rows_bound=rows)) \
        .where((F.col("cand_rank") <= F.col("n") + k) | (F.col("cand_rank") == F.col("least")))
    picked = first_gaps(near.select("visitorid", "cand_rank"), k)
    # ranks beyond the number of items (small catalogue) find no partner; they come after all real ones
    return salted_join(picked, ranks, "cand_rank", rows_bound=n_users * k).select("visitorid", "rank", "itemid"), held


def recommend_popular(train: DataFrame, k: int, exclude_seen: bool = True) -> RecList:
    """M1: per train user, the first k of the global ranking not yet seen.

    Of a user who has seen m of the first T ranks, the first k unseen lie among the first m + k: with T broadcast, no
    history moves by item, and a list is settled if m + k <= T.  Users who have seen more (each has at least T - k
    of the rows, so they are few) get theirs from the whole ranking (``whole_history_lists``).  Every train user gets a
    row, even when its list is short or empty.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = train.select("visitorid", "itemid")
    users = pairs.select("visitorid").distinct()
    if not exclude_seen:
        top = F.broadcast(popular_candidates(train, k).select("cand_rank", "itemid"))  # k rows
        picked = users.select("visitorid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("cand_rank"))
        return RecList(picked.join(top, "cand_rank").select("visitorid", F.col("cand_rank").alias("rank"), "itemid"), users)
    top_n = max(TOP_RANKS, 2 * k)
    top = popular_candidates(train, top_n).select("cand_rank", "itemid").persist()  # read by both joins
    held = pairs.join(F.broadcast(top), "itemid").select("visitorid", "cand_rank").persist()  # counted, then gathered
    seen = held.groupBy("visitorid").agg(F.count(F.lit(1)).alias("n"))
    most = seen.agg(F.max("n")).first()[0] or 0
    # a user is named by an item, as in the whole ranking
    listed = pairs.where(F.col("visitorid").isNotNull()).groupBy("visitorid").agg(F.count("itemid").alias("n_items")).where("n_items > 0")
    busy = seen.where(F.col("n") + k > top_n).select("visitorid") if most + k > top_n and top.count() == top_n else None
    if busy is not None:
        busy = busy.persist()
        listed, held_few = listed.join(busy, "visitorid", "left_anti"), held.join(busy, "visitorid", "left_anti")
    else:
        held_few = held
    gathered = held_few.groupBy("visitorid").agg(F.collect_set("cand_rank").alias("held"))  # at most top_n ranks
    taken = F.coalesce("held", F.array().cast("array<int>"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size(taken) + k), taken), 1, k)
    picked = listed.select("visitorid").join(gathered, "visitorid", "left").select("visitorid", F.posexplode(free).alias("pos", "cand_rank"))
    # ranks beyond the number of items (small catalogue) find no partner; they come after all real ones
    long = picked.join(F.broadcast(top), "cand_rank").select("visitorid", (F.col("pos") + 1).alias("rank"), "itemid")
    if busy is None:
        return RecList(long, users, (top, held))
    ranks = popularity_ranks(train).select("cand_rank", "itemid").persist()  # read by both joins
    rest, of_rest = whole_history_lists(salted_join(pairs, busy, "visitorid", "left_semi"), ranks, k)
    return RecList(long.unionByName(rest), users, (top, held, busy, ranks, of_rest))
