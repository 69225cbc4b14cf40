"""Goldens of the reference's own tests, restated on our API."""

from __future__ import annotations

import math

import pytest

from clickrank.functions import (
    average_precision_at_k,
    event_weight_or_zero,
    implicit_score,
    ndcg_at_k,
    precision_at_k,
    recall_at_k,
)
from clickrank.operators.clean import clean_events
from clickrank.operators.evaluate import evaluate_recommendations, per_user_metrics
from clickrank.operators.interactions import aggregate_interactions
from clickrank.operators.reclist import from_arrays
from clickrank.operators.split import exact_cutoff

WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}


def test_event_weight_values(spark):
    df = spark.createDataFrame([("view",), ("addtocart",), ("transaction",), ("unknown",)], "event string")
    got = dict(df.select("event", event_weight_or_zero("event", WEIGHTS).alias("w")).collect())
    assert got == {"view": 1.0, "addtocart": 3.0, "transaction": 5.0, "unknown": 0.0}


def test_implicit_score(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,)], "raw double")
    rows = df.select("raw", implicit_score("raw").alias("log"), implicit_score("raw", False).alias("plain")).collect()
    assert [r.plain for r in rows] == [0.0, 1.0, 5.0]
    assert [r.log for r in rows] == pytest.approx([math.log1p(r.raw) for r in rows])


def test_array_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [2, 4, 5])], "rec array<int>, rel array<int>")
    row = df.select(
        precision_at_k("rec", "rel", 4).alias("p"),
        recall_at_k("rec", "rel", 4).alias("r"),
        average_precision_at_k("rec", "rel", 4).alias("ap"),
        ndcg_at_k("rec", "rel", 4).alias("ndcg"),
    ).first()
    assert row.p == 0.5
    assert row.r == pytest.approx(2 / 3)
    assert row.ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert row.ndcg > 0
    idcg = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert row.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / idcg)


def test_long_form_metrics_match_array_form(spark):
    lists = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9]), (3, [])], "visitorid int, recommendations array<int>")
    relevant = spark.createDataFrame([(1, 2), (1, 4), (1, 5), (2, 7), (3, 1)], "visitorid int, itemid int")
    recs = from_arrays(lists)
    per_user = {r.visitorid: r for r in per_user_metrics(recs, relevant, 4).collect()}
    assert per_user[1].precision_at_4 == 0.5
    assert per_user[1].recall_at_4 == pytest.approx(2 / 3)
    assert per_user[1].map_at_4 == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert per_user[2].precision_at_4 == 0.0 and per_user[3].ndcg_at_4 == 0.0
    # the user with an empty list is evaluated (scores 0)
    summary = evaluate_recommendations(recs, relevant, 10, 4).first()
    assert summary.test_users == 3
    assert summary.precision_at_4 == pytest.approx(0.5 / 3)
    assert summary.coverage == pytest.approx(5 / 10)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([([1, 2], [])], "rec array<int>, rel array<int>")
    row = df.select(precision_at_k("rec", "rel", 3).alias("p"), recall_at_k("rec", "rel", 3).alias("r"),
                    ndcg_at_k("rec", "rel", 3).alias("n"), precision_at_k("rec", "rel", 0).alias("p0")).first()
    assert (row.p, row.r, row.n, row.p0) == (0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        average_precision_at_k("rec", "rel", 0)


@pytest.mark.parametrize("values,ratio,expected", [([10, 20, 30, 40, 50], 0.8, 40), ([30, 10, 20], 0.5, 10)])
def test_cutoff_goldens(spark, values, ratio, expected):
    df = spark.createDataFrame([(v,) for v in values], "timestamp long")
    assert exact_cutoff(df, ratio) == expected


def test_cutoff_empty(spark):
    with pytest.raises(ValueError):
        exact_cutoff(spark.createDataFrame([], "timestamp long"), 0.5)


def test_smoke_pipeline(spark):
    rows = [
        (1000, 1, "view", 10, None),
        (2000, 1, "addtocart", 10, None),
        (3000, 2, "transaction", 11, "t1"),
        (4000, 2, "view", 10, None),
    ]
    df = spark.createDataFrame(rows, "timestamp long, visitorid int, event string, itemid int, transactionid string")
    inter = aggregate_interactions(clean_events(df, WEIGHTS), True, 1, 1)
    assert "score" in inter.columns
    got = {(r.visitorid, r.itemid): (r.score, r.event_count) for r in inter.collect()}
    expected = {(1, 10): (math.log(5), 2), (2, 11): (math.log(6), 1), (2, 10): (math.log(2), 1)}
    assert got.keys() == expected.keys()
    for key, (score, count) in expected.items():
        assert got[key][0] == pytest.approx(score) and got[key][1] == count
