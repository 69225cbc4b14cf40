"""Offline evaluation (E1-E5, A10, A11, J7, P18) on long-form lists.

Per user, only the hits matter: the list rows (rank <= k) are joined to the
relevant pairs, and the at most k hit ranks of a user are enough for
precision, recall, AP and NDCG.  Users that received a list and have a
non-empty relevant set are averaged (a user with an empty list scores 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.ranking import ideal_dcg
from clickrank.operators.reclist import RecList

METRIC_NAMES = ("precision", "recall", "map", "ndcg")


def metric_columns(k: int) -> list[str]:
    return [f"{name}_at_{k}" for name in METRIC_NAMES]


def _hit_stats(recs: RecList, relevant: DataFrame, k: int) -> DataFrame:
    hits = recs.long.where(F.col("rank") <= k).join(relevant.select("visitorid", "itemid"), ["visitorid", "itemid"])
    ranks = hits.groupBy("visitorid").agg(F.sort_array(F.collect_list("rank")).alias("hit_ranks"))
    # AP numerator: at the j-th hit (1-based) with list rank r, add j / r
    ap_sum = F.aggregate(
        F.transform("hit_ranks", lambda r, j: (j + 1) / r.cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    dcg = F.aggregate(
        F.transform("hit_ranks", lambda r: 1.0 / F.log2(r + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return ranks.select("visitorid", F.size("hit_ranks").alias("hits"), ap_sum.alias("ap_sum"), dcg.alias("dcg"))


def per_user_metrics(recs: RecList, relevant: DataFrame, k: int, population: str = "listed") -> DataFrame:
    """E1-E4 per evaluated user: (visitorid, precision_at_k, recall_at_k, map_at_k, ndcg_at_k).

    ``relevant`` holds distinct (visitorid, itemid) pairs.  ``population``:
    ``listed`` (the reference) evaluates users that received a list and have
    relevant items; ``all_relevant`` evaluates every user with relevant items
    and scores a missing list as 0, so models are averaged over the same users.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    sizes = relevant.groupBy("visitorid").agg(
        F.count(F.lit(1)).alias("n_relevant")
    )
    if population == "listed":
        users = recs.users.join(sizes, "visitorid").where(F.col("n_relevant") > 0)
    elif population == "all_relevant":
        users = sizes.where(F.col("n_relevant") > 0)
    else:
        raise ValueError(f"unknown population {population!r}")
    stats = users.join(_hit_stats(recs, relevant, k), "visitorid", "left").fillna(
        {"hits": 0, "ap_sum": 0.0, "dcg": 0.0}
    )
    ideal = F.least(F.col("n_relevant"), F.lit(k))
    p, r, ap, nd = metric_columns(k)
    return stats.select(
        "visitorid",
        (F.col("hits") / F.lit(float(k))).alias(p),
        (F.col("hits") / F.col("n_relevant")).alias(r),
        (F.col("ap_sum") / ideal).alias(ap),
        F.coalesce(F.col("dcg") / F.nullif(ideal_dcg(ideal), F.lit(0.0)), F.lit(0.0)).alias(nd),
    )


def catalog_size(train: DataFrame) -> Column:
    """Distinct train items, as a scalar subquery."""
    return train.select(F.count_distinct("itemid")).scalar()


def coverage(recs: RecList, catalog_items: Column | int) -> Column:
    """Distinct items over all lists / catalogue size (0 for an empty catalogue)."""
    distinct_items = recs.long.select(F.count_distinct("itemid")).scalar()
    catalog = F.lit(catalog_items) if isinstance(catalog_items, int) else catalog_items
    return F.when(catalog > 0, distinct_items / catalog).otherwise(F.lit(0.0))


def evaluate_recommendations(recs: RecList, relevant: DataFrame, catalog_items: Column | int, k: int,
                             population: str = "listed") -> DataFrame:
    """E5: one row with the four averaged metrics, coverage and the number of users.

    The coverage and catalogue counts are scalar subqueries, so the whole
    evaluation is one lazy query.  Coverage always spans every list.
    """
    metrics = per_user_metrics(recs, relevant, k, population)
    p, r, ap, nd = metric_columns(k)
    aggregated = metrics.agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in (p, r, ap, nd)],
        F.count(F.lit(1)).alias("test_users"),
    )
    return aggregated.select(p, r, ap, nd, coverage(recs, catalog_items).cast("double").alias("coverage"), "test_users")
