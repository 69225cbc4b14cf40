"""Array output shapes of the reference (lists, histories, relevant sets) and their round trips."""

from __future__ import annotations

from clickrank.operators.reclist import RecList, from_arrays
from clickrank.operators.split import relevant_arrays


def test_reclist_arrays_keep_empty_lists_and_round_trip(spark):
    long = spark.createDataFrame([(1, 2, 30), (1, 1, 10), (2, 1, 20)], "visitorid int, rank int, itemid int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "visitorid int")
    arrays = {r.visitorid: r.recommendations for r in RecList(long, users).arrays().collect()}
    assert arrays == {1: [10, 30], 2: [20], 3: []}
    back = from_arrays(RecList(long, users).arrays())
    assert sorted(map(tuple, back.long.collect())) == [(1, 1, 10), (1, 2, 30), (2, 1, 20)]
    assert back.users.count() == 3


def test_relevant_arrays(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "visitorid int, itemid int")
    rel = {r.visitorid: sorted(r.relevant_items) for r in relevant_arrays(pairs).collect()}
    assert rel == {1: [5, 7], 2: [5]}
