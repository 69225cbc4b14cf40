"""The distributed ranking and the first free ranks of each user, against plain lists."""

from __future__ import annotations

import random

import pytest

from clickrank.operators import skew
from clickrank.operators.popularity import first_gaps, popularity_ranks, recommend_popular


def test_ranks_are_the_sorted_order(spark):
    rng = random.Random(1)
    rows = [(u, i, float(rng.randint(0, 3))) for u in range(30) for i in rng.sample(range(200), 12)]
    train = spark.createDataFrame(rows, "visitorid int, itemid int, score double").repartition(5)
    total = {}
    for _, i, s in rows:
        total[i] = total.get(i, 0) + s
    want = [i for i, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))]
    got = {r.cand_rank: r.itemid for r in popularity_ranks(train).collect()}
    assert got == {n + 1: i for n, i in enumerate(want)}


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_first_gaps(spark, block):
    rng = random.Random(2)
    seen = {u: set(rng.sample(range(1, 60), rng.randint(1, 50))) for u in range(60)}
    seen[100] = set(range(1, 501))  # everything up to a point
    seen[101] = set(range(1, 500, 2))  # half of all
    seen[102] = {5000}
    seen[103] = set(range(1, 41)) | set(range(44, 300)) | {900}
    frame = spark.createDataFrame([(u, r) for u, x in seen.items() for r in x] + [(102, 5000)], "visitorid int, cand_rank int").repartition(4)
    for k in (1, 5, 20):
        got = sorted(tuple(r) for r in first_gaps(frame, k, block).select("visitorid", "rank", "cand_rank").collect())
        want = []
        for u, x in sorted(seen.items()):
            free = [r for r in range(1, 6000) if r not in x][:k]
            want += [(u, n + 1, r) for n, r in enumerate(free)]
        assert got == want, (k, block)


def test_a_user_who_saw_half_of_the_catalogue(spark):
    rows = [(1, i, 2.0) for i in range(0, 4000, 2)] + [(2, i, 1.0) for i in (0, 1, 2)] + [(3, i, 1.0) for i in range(4000)]
    train = spark.createDataFrame(rows, "visitorid int, itemid int, score double")
    lists = {}
    for r in recommend_popular(train, 5).long.collect():
        lists.setdefault(r.visitorid, {})[r.rank] = r.itemid
    assert lists[1] == {1: 1, 2: 3, 3: 5, 4: 7, 5: 9}
    assert [lists[2][r] for r in range(1, 6)] == [4, 6, 8, 10, 12]
    assert 3 not in lists and recommend_popular(train, 5).users.where("visitorid = 3").count() == 1


def test_seen_ranks_are_joined_once(spark):
    train = spark.createDataFrame([(u, i, 1.0) for u in range(5) for i in range(u, 9)], "visitorid int, itemid int, score double")
    recs = recommend_popular(train, 3)
    ranks, held = recs.kept  # the joined pairs feed the counts and the filter
    assert held.storageLevel.useMemory and held.columns == ["visitorid", "cand_rank"]
    recs.unpersist()
    assert not held.storageLevel.useMemory


def test_no_second_pass_without_a_hot_key(spark):
    passes = spark.sparkContext.accumulator(0)

    def counted(rows):
        passes.add(1)
        yield from rows

    counts = spark.createDataFrame([(1, 5), (2, 5)], "k int, n long").coalesce(1).mapInArrow(counted, "k int, n long")
    assert skew.hot_keys(counts, "k", min_rows=100) == [] and passes.value == 1
    assert skew.hot_keys(counts, "k", share=0.4, min_rows=4) == [1, 2]
    assert skew.hot_keys(counts.where("k > 9"), "k", min_rows=0) == []
