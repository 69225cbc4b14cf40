"""Popularity lists out of the first ranks, and the support filter by the keys that fail it, against plain lists."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from clickrank.operators import interactions, popularity
from clickrank.operators.interactions import support_filter
from clickrank.operators.popularity import popular_candidates, popularity_ranks, recommend_popular


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _brute_lists(rows, k: int) -> list:
    total, seen = Counter(), {}
    for u, i, s in rows:
        total[i] += s
        seen.setdefault(u, set()).add(i)
    order = sorted(total, key=lambda i: (-total[i], i is not None, i or 0))
    return sorted((u, n + 1, i if i is not None else -1) for u, x in seen.items() if u is not None and x != {None}
                  for n, i in enumerate([i for i in order if i is None or i not in x][:k]))


@pytest.mark.parametrize("top", [3, 8, 1024])
def test_lists_from_the_first_ranks_and_of_busy_users(spark, monkeypatch, top):
    monkeypatch.setattr(popularity, "TOP_RANKS", top)
    rng = random.Random(top)
    rows = [(u, i, float(rng.randint(0, 4))) for u in range(25) for i in rng.choices(range(30), k=rng.randint(1, 25))]
    rows += [(None, 3, 1.0), (90, None, 2.0), (91, None, 1.0), (91, 5, 1.0), (92, 29, 0.0)] + [(93, i, 0.0) for i in range(30)]
    train = spark.createDataFrame(rows, "visitorid int, itemid int, score double").repartition(4)
    recs = recommend_popular(train, 4)
    got = sorted((r.visitorid, r.rank, -1 if r.itemid is None else r.itemid) for r in recs.long.collect())
    assert got == _brute_lists(rows, 4)
    assert recs.users.count() == len({r[0] for r in rows})
    recs.unpersist()


def test_short_histories_need_no_whole_ranking(spark, monkeypatch):
    def whole(train):
        raise AssertionError("every item was ranked")

    train = spark.createDataFrame([(u, (7 * u + i) % 50, 1.0) for u in range(40) for i in range(5)], "visitorid int, itemid int, score double")
    ranks = sorted(tuple(r) for r in popularity_ranks(train).where("cand_rank <= 20").collect())
    monkeypatch.setattr(popularity, "popularity_ranks", whole)
    assert recommend_popular(train, 10).long.count() == 400
    assert sorted(tuple(r) for r in popular_candidates(train, 20).collect()) == ranks


@pytest.mark.parametrize("most", [0, 500_000])
def test_few_keys_below_the_support_move_no_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(interactions, "MAX_BROADCAST_KEYS", most)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(25)]), 1.0, 1, None) for _ in range(90)]
    pairs = spark.createDataFrame(rows, "visitorid int, itemid int, score double, event_count long, last_event_ts timestamp")
    users, items = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
    got = support_filter(pairs, 3, 4)
    want = [(r[0], r[1]) for r in rows if None not in r[:2] and users[r[0]] >= 3 and items[r[1]] >= 4]
    assert 0 < len(want) < len(rows) and Counter((r.visitorid, r.itemid) for r in got.collect()) == Counter(want)
    if most:
        joins = _plan(got)
        assert "SortMergeJoin" not in joins and joins.count("LeftAnti") >= 2
