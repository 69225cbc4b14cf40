"""Item-item co-occurrence recommender.

Stages, each usable on its own:

* ``pair_support``   - for users with at most ``max_items`` items, each item of a
  history goes with the whole history, as one array, to the item's task, where
  the candidates are counted.
* ``top_similar``    - per item, the ``top_n`` candidates by support, ties by
  candidate id.
* ``candidate_scores`` - every (uncapped) user history joined to its items'
  neighbours, one array per item, summed per (user, candidate), minus the user's
  own items.
* ``recommend_cooccurrence`` - first k per user by score, ties by candidate.

What is shuffled is arrays of four-byte candidates, never a row per pair: both sums
take place in the task that holds a key's arrays (``packed_sums``), which can hand
on the best few of each key only.  Where all supports are asked for, a pair travels
once, with its lower item.  Lists of many users are made in passes over a part of
the items, then of the users, each part's results written and its shuffle files
dropped before the next, so that the disk holds a bounded number of candidates for
each row of the train table, however long the histories are.

Similarity is the raw co-occurrence count and the train score is ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.operators.packed import packed_sums
from clickrank.operators.reclist import RecList
from clickrank.operators.skew import hot_keys, key_counts, salted_join
from clickrank.session import drop_path, scratch_path, shuffles_dropped

#: A history goes out as arrays of about this many items.
BLOCK_ITEMS = 1000
#: A pass shuffles about so many candidates for each row of the train table, or so many in all if these are more.
ROW_CANDIDATES = 8
PASS_CANDIDATES = 250_000_000


def blocked_histories(train: DataFrame, max_items: int | None, rows_bound: int | None = None) -> DataFrame:
    """(visitorid, itemid, blocks): the pairs, and the number of blocks of the user's history.

    Sizes are counted per user (partial aggregation) and joined back; a long
    history is streamed past, never buffered.  ``max_items`` leaves out users
    with more items; without it all users stay.
    """
    pairs = train.select("visitorid", "itemid")
    sizes = pairs.groupBy("visitorid").agg(F.count(F.lit(1)).alias("n"))
    keep = sizes if max_items is None else sizes.where(F.col("n") <= max_items)
    keep = keep.select("visitorid", F.ceil(F.col("n") / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks"))
    return salted_join(pairs, keep, "visitorid", "inner", hot=hot_keys(sizes, "visitorid", rows_bound=rows_bound))


def history_blocks(train: DataFrame, max_items: int | None = None, rows_bound: int | None = None) -> DataFrame:
    """(visitorid, blocks, block, items): the histories in sorted arrays of about BLOCK_ITEMS items, dealt by a hash of the item."""
    own = blocked_histories(train.where(F.col("visitorid").isNotNull() & F.col("itemid").isNotNull()), max_items, rows_bound)
    own = own.withColumn("block", F.pmod(F.hash("itemid"), F.col("blocks")))
    return own.groupBy("visitorid", "blocks", "block").agg(F.sort_array(F.collect_list("itemid")).alias("items"))


def history_arrays(arrays: DataFrame, wanted: Column | None = None, half: bool = False) -> DataFrame:
    """(itemid, items): for each item of a history (``wanted``: of those only), the history in its arrays.

    A long history's blocks meet block by block, so that it is spread over many tasks.  ``half``: only the items that are
    not below the item, so that each pair of them comes once.
    """
    after = F.slice("items", F.col("pos") + 2, F.size("items") - F.col("pos") - 1)  # the arrays are sorted
    single = arrays.where("blocks = 1").select("items", F.posexplode("items").alias("pos", "itemid"))
    whole = single.select("itemid", (after if half else F.col("items")).alias("items"))
    parts, others = arrays.where("blocks > 1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = parts.select("visitorid", F.col("items").alias("own_items"), F.col("block").alias("block_a"), others.alias("block_b"))
    b = parts.select("visitorid", "items", others.alias("block_a"), F.col("block").alias("block_b"))
    met = a.join(b, ["visitorid", "block_a", "block_b"]).select(F.explode("own_items").alias("itemid"), "items")
    if half:
        met = met.select("itemid", F.filter("items", lambda x: x > F.col("itemid")).alias("items"))
    out = whole.unionByName(met)
    out = out if wanted is None else out.where(wanted)
    return out.where(F.size("items") > 0) if half else out


def _counted(met: DataFrame, hot: list, best: int | None) -> DataFrame:
    return packed_sums(met.select("itemid", F.col("itemid").alias("own"), F.col("items").alias("candidates"), F.lit(None).alias("amounts")),
                       "itemid", "candidate_itemid", "similarity", hot, best)


def pair_support(train: DataFrame, max_items: int | None = None, rows_bound: int | None = None,
                 best: int | None = None) -> DataFrame:
    """J5 + A7 + P16: ordered (itemid, candidate_itemid, similarity), self-pairs excluded.

    All pairs are counted at their lower item and handed on in both orders.  ``best``: hand on that many candidates of
    each item at least, the first by similarity desc, candidate asc, instead of all; ``top_similar`` of as many is the
    same, and each item then needs its whole histories.
    """
    arrays = history_blocks(train, max_items, rows_bound)
    hot = hot_keys(key_counts(train, "itemid"), "itemid", rows_bound=rows_bound)
    counted = _counted(history_arrays(arrays, half=best is None), hot, best)
    if best is not None:
        return counted
    a, b, n = "itemid", "candidate_itemid", "similarity"
    both = F.array(F.struct(F.col(a), F.col(b), F.col(n)), F.struct(F.col(b).alias(a), F.col(a).alias(b), F.col(n)))
    return counted.select(F.inline(both))


def top_similar(similarities: DataFrame, top_n: int = 50) -> DataFrame:
    """Per item, the ``top_n`` candidates by similarity desc, candidate asc."""
    order = Window.partitionBy("itemid").orderBy(F.desc("similarity"), F.asc("candidate_itemid"))
    return (
        similarities.withColumn("sim_rank", F.row_number().over(order))
        .where(F.col("sim_rank") <= top_n)
        .select("itemid", "candidate_itemid", "similarity")
    )


def candidate_scores(train: DataFrame, neighbours: DataFrame, top_n: int | None = None,
                     rows_bound: int | None = None, best: int | None = None) -> DataFrame:
    """J4 + A8 + P17: summed similarity per (visitorid, candidate) for unseen candidates.

    The neighbours are gathered into one row of arrays per item and joined to the histories on the item (hot items
    salted, since the arrays arrive partitioned by item and AQE cannot split them).  A user's arrays are summed in one
    task, which also leaves out the user's own items; a hot user's candidates are dealt over many.  ``best``: hand on
    that many candidates of each user at least, the first by score desc, candidate asc, instead of all.  ``top_n``: an
    item has at most so many neighbours; the plan is the same for every number.
    """
    history = train.select("visitorid", "itemid")
    joined = salted_join(history, neighbour_arrays(neighbours), "itemid", "inner", rows_bound=rows_bound)
    hot = hot_keys(key_counts(history, "visitorid"), "visitorid", rows_bound=rows_bound)
    return _summed(joined, hot, best)


def neighbour_arrays(neighbours: DataFrame) -> DataFrame:
    """(itemid, near): the neighbours of an item in one row."""
    return neighbours.groupBy("itemid").agg(F.collect_list(F.struct("candidate_itemid", "similarity")).alias("near"))


def _summed(joined: DataFrame, hot: list, best: int | None) -> DataFrame:
    # own items without neighbours are nobody's candidates: they come with the join or not at all
    return packed_sums(joined.select("visitorid", F.col("itemid").alias("own"), F.col("near.candidate_itemid").alias("candidates"),
                                     F.col("near.similarity").alias("amounts")), "visitorid", "candidate_itemid", "score", hot, best)


def rank_candidates(scores: DataFrame, k: int) -> DataFrame:
    """(visitorid, rank, itemid) for the first k candidates by score desc, candidate asc."""
    order = Window.partitionBy("visitorid").orderBy(F.desc("score"), F.asc("candidate_itemid"))
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("visitorid", "rank", F.col("candidate_itemid").alias("itemid"))
    )


def recommend_cooccurrence(train: DataFrame, k: int, max_items_per_user_for_pairs: int | None = None,
                           top_similar_items_per_item: int = 50) -> RecList:
    """M2: users with no unseen candidate get no list."""
    if k <= 0:
        raise ValueError("k must be positive")
    top_n = top_similar_items_per_item
    rows, bound, met = _sizes(train, max_items_per_user_for_pairs)
    of_items, of_users = _passes(met, rows), _passes(rows * top_n, rows)
    if max(of_items, of_users) == 1:
        neighbours = top_similar(pair_support(train, max_items_per_user_for_pairs, bound, top_n), top_n)
        long = rank_candidates(candidate_scores(train, neighbours, top_n, bound, k), k)
        return RecList(long, long.where(F.col("rank") == 1).select("visitorid"))
    spark = train.sparkSession
    arrays, stored = _in_passes(train, "cooc-histories", 1, lambda _: history_blocks(train, max_items_per_user_for_pairs, bound))
    hot_items = hot_keys(key_counts(train, "itemid"), "itemid", rows_bound=bound)
    hot_users = hot_keys(key_counts(train, "visitorid"), "visitorid", rows_bound=bound)
    near, near_stored = _in_passes(train, "cooc-neighbours", of_items, lambda mine: neighbour_arrays(
        top_similar(_counted(history_arrays(arrays, mine("itemid")), hot_items, top_n), top_n)))
    drop_path(spark, stored)
    history = train.select("visitorid", "itemid")
    long, _ = _in_passes(train, "cooc-lists", of_users, lambda mine: rank_candidates(
        _summed(salted_join(history.where(mine("visitorid")), near, "itemid", "inner", hot=hot_items), hot_users, k), k))
    drop_path(spark, near_stored)
    return RecList(long, long.where(F.col("rank") == 1).select("visitorid"))


def _sizes(train: DataFrame, max_items: int | None) -> tuple[int, int, int]:
    """(rows, the most rows of a user or item, the candidates that all histories send to their items)."""
    n = F.col("n")
    kept = n * n if max_items is None else F.when(n <= max_items, n * n)
    rows, of_user, met = key_counts(train, "visitorid").agg(F.sum(n), F.max(n), F.sum(kept.cast("decimal(38,0)"))).first()
    of_item, = key_counts(train, "itemid").agg(F.max(n)).first()
    return rows or 0, max(of_user or 0, of_item or 0), int(met or 0)


def _passes(candidates: int, rows: int) -> int:
    return max(1, -(-candidates // max(PASS_CANDIDATES, ROW_CANDIDATES * rows)))


def _in_passes(train: DataFrame, name: str, passes: int, build: Callable[[Callable[[str], Column]], DataFrame]) -> tuple[DataFrame, str]:
    """What ``build`` makes of each part of the keys (it gets a condition on a key), written to one scratch table, and its path."""
    spark = train.sparkSession
    path = scratch_path(spark, name)
    for i in range(passes):
        # not the hash that the rows are dealt over tasks by
        part = build(lambda key, i=i: F.pmod(F.xxhash64(key), F.lit(passes)) == i)
        with shuffles_dropped(spark):
            part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path), path
