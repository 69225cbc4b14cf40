"""Operator behaviour and invariances on the driver tables (sf0.001) and hand-made inputs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from clickrank.operators.als import recommend_als
from clickrank.operators.clean import clean_events
from clickrank.operators.cooccurrence import pair_support, recommend_cooccurrence
from clickrank.operators.evaluate import catalog_size, evaluate_recommendations
from clickrank.operators.interactions import deterministic_user_sample, support_filter
from clickrank.operators.popularity import recommend_popular
from clickrank.operators.split import build_train_test, exact_cutoff
from clickrank.plans import queries
from clickrank.sources import orders_fixture

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def split(spark):
    tt = build_train_test(clean_events(orders_fixture(spark, SF_SMALL)))
    yield tt
    tt.release()


def test_exact_cutoff_matches_sorted_definition(spark):
    rng = random.Random(7)
    values = [rng.choice([5, 5, 5, 17, 1000, 10**12]) + rng.randrange(0, 50) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "timestamp long").repartition(7)
    for ratio in (0.0, 0.001, 0.25, 0.5, 0.8, 0.999, 1.0, 1.5):
        assert exact_cutoff(df, ratio, buckets=16) == sorted(values)[min(max(int(len(values) * ratio), 1), len(values)) - 1]


def test_support_filter_uses_unfiltered_counts(spark):
    # user 1 has 2 items, user 2 has 1; item 10 has 2 users, item 11 has 1
    df = spark.createDataFrame([(1, 10, 1.0, 1, None), (1, 11, 1.0, 1, None), (2, 10, 1.0, 1, None)],
                               "visitorid int, itemid int, score double, event_count long, last_event_ts timestamp")
    kept = {(r.visitorid, r.itemid) for r in support_filter(df, 2, 2).collect()}
    assert kept == {(1, 10)}


def test_user_sample_keeps_whole_users(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL))
    sampled = deterministic_user_sample(ev, 0.5)
    users = {r.visitorid for r in sampled.select("visitorid").distinct().collect()}
    per_user_all = dict(ev.groupBy("visitorid").count().collect())
    per_user_kept = dict(sampled.groupBy("visitorid").count().collect())
    assert users and all(per_user_kept[u] == per_user_all[u] for u in users)
    assert deterministic_user_sample(ev, 1.0) is ev


def test_popular_lists_exclude_seen_and_cover_all_users(spark, split):
    recs = recommend_popular(split.train, 10)
    arrays = recs.arrays()
    assert arrays.count() == split.train.select("visitorid").distinct().count()
    seen = recs.long.join(split.train, ["visitorid", "itemid"]).count()
    assert seen == 0
    sizes = recs.long.groupBy("visitorid").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()
    assert all(r.n <= 10 and r.m == r.n for r in sizes)


def test_pair_support_matches_brute_force(spark, split):
    cap = 30
    hist = {}
    for r in split.train.select("visitorid", "itemid").collect():
        hist.setdefault(r.visitorid, set()).add(r.itemid)
    expected = {}
    for items in hist.values():
        if len(items) <= cap:
            for a, b in combinations(sorted(items), 2):
                expected[(a, b)] = expected.get((a, b), 0) + 1
                expected[(b, a)] = expected.get((b, a), 0) + 1
    got = {(r.itemid, r.candidate_itemid): r.similarity for r in pair_support(split.train, cap).collect()}
    assert got == expected


def test_registered_pair_support_has_every_user(spark):
    hist = {}
    for r in queries.split(spark, SF_SMALL, "orders").train.select("visitorid", "itemid").collect():
        hist.setdefault(r.visitorid, set()).add(r.itemid)
    assert max(map(len, hist.values())) > queries.PAIR_CAP
    expected = Counter(p for items in hist.values() for p in permutations(items, 2))
    rows = queries.QUERIES["pair_support"](spark, SF_SMALL).collect()
    assert {(r.itemid, r.candidate_itemid): r.similarity for r in rows} == expected


def test_cooccurrence_lists_are_unseen_and_ranked(spark, split):
    recs = recommend_cooccurrence(split.train, 5)
    assert recs.long.join(split.train, ["visitorid", "itemid"]).count() == 0
    sizes = recs.long.groupBy("visitorid").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()
    assert sizes and all(r.n <= 5 and r.m == r.n for r in sizes)
    assert recs.users.count() == len(sizes)


def test_partition_invariance(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL))
    results = set()
    for n in (1, 3, 8):
        tt = build_train_test(ev.repartition(n, "visitorid"))
        row = evaluate_recommendations(recommend_popular(tt.train, 10), tt.relevant, catalog_size(tt.train), 10).first()
        results.add(tuple(round(v, 12) for v in row))
        tt.release()
    assert len(results) == 1


def test_metrics_in_unit_interval(spark, split):
    for recs in (recommend_popular(split.train, 10), recommend_cooccurrence(split.train, 10)):
        row = evaluate_recommendations(recs, split.relevant, catalog_size(split.train), 10).first()
        assert all(0.0 <= row[c] <= 1.0 for c in ("precision_at_10", "recall_at_10", "map_at_10", "ndcg_at_10",
                                                    "coverage"))


def test_relevance_fallback(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL))
    tt = build_train_test(ev, relevant_events=("no_such_event",))
    assert tt.used_fallback and tt.relevant.count() > 0
    tt.release()


def test_als_repeatable_and_unseen(spark, split):
    users = split.relevant.select("visitorid")
    first, _ = recommend_als(split.train, users, 10, 4, 0.1, 10.0, 3)
    second, _ = recommend_als(split.train.repartition(3), users, 10, 4, 0.1, 10.0, 3)
    a = sorted(tuple(r) for r in first.long.collect())
    b = sorted(tuple(r) for r in second.long.collect())
    assert a == b and a
    assert first.long.join(split.train, ["visitorid", "itemid"]).count() == 0
    assert first.long.join(users, "visitorid", "left_anti").count() == 0


def test_checkpoint_keep_mode_gives_same_split(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL))
    kept = build_train_test(ev, keep="persist")
    cut = build_train_test(ev, keep="checkpoint")
    assert kept.cutoff == cut.cutoff
    assert sorted(map(tuple, kept.train.select("visitorid", "itemid").collect())) == \
        sorted(map(tuple, cut.train.select("visitorid", "itemid").collect()))
    assert kept.relevant.count() == cut.relevant.count()
    kept.release()


def test_candidate_scores_broadcast_and_shuffle_paths_agree(spark, split):
    from clickrank.operators.cooccurrence import candidate_scores, top_similar

    neighbours = top_similar(pair_support(split.train, 100), 50)
    broadcast_path = candidate_scores(split.train, neighbours, 50)  # small catalogue, no hot user
    shuffle_path = candidate_scores(split.train, neighbours)  # no size bound given
    a = sorted(tuple(r) for r in broadcast_path.collect())
    b = sorted(tuple(r) for r in shuffle_path.collect())
    assert a == b and a


def test_empty_inputs(spark):
    from clickrank.operators.skew import hot_keys, key_counts

    empty = spark.createDataFrame([], "visitorid int, itemid int, score double, event_count long, "
                                      "last_event_ts timestamp")
    assert hot_keys(key_counts(empty, "itemid"), "itemid", min_rows=0) == []
    assert recommend_popular(empty, 5).long.count() == 0
    assert recommend_cooccurrence(empty, 5).long.count() == 0
    relevant = spark.createDataFrame([], "visitorid int, itemid int")
    row = evaluate_recommendations(recommend_popular(empty, 5), relevant, catalog_size(empty), 5).first()
    assert row.test_users == 0 and row.precision_at_5 == 0.0 and row.coverage == 0.0


def test_release_keeps_callers_cache(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL)).persist()
    tt = build_train_test(ev)
    tt.release()
    assert ev.storageLevel.useMemory or ev.storageLevel.useDisk
    ev.unpersist()
