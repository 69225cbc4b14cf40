"""Column functions: time conversion, hashing buckets, weights, scores."""

from __future__ import annotations

import datetime as dt
import math


from clickrank.functions import epoch_ms_to_timestamp, event_weight, implicit_score, sample_threshold, user_bucket


def test_epoch_ms_truncates_milliseconds(spark):
    df = spark.createDataFrame([(1433221332117,), (1999,), (-1500,)], "ms long")
    got = [r.t for r in df.select(epoch_ms_to_timestamp("ms").alias("t")).collect()]
    utc = dt.timezone.utc
    expected = [dt.datetime(2015, 6, 2, 5, 2, 12, tzinfo=utc), dt.datetime(1970, 1, 1, 0, 0, 1, tzinfo=utc),
                dt.datetime(1969, 12, 31, 23, 59, 59, tzinfo=utc)]  # toward zero, like from_unixtime(ms / 1000)
    assert [g.astimezone(utc) for g in got] == expected


def test_user_bucket_range_and_int_min(spark):
    df = spark.createDataFrame([(-2147483648,), (2147483647,), (0,), (42,)], "v int")
    buckets = [r.b for r in df.select(user_bucket("v").alias("b")).collect()]
    assert all(0 <= b < 10000 for b in buckets)
    assert sample_threshold(0.25) == 2500 and sample_threshold(1.0) == 10000


def test_event_weight_null_for_unknown(spark):
    df = spark.createDataFrame([("view",), ("other",), (None,)], "event string")
    got = [r.w for r in df.select(event_weight("event", {"view": 2.0}).alias("w")).collect()]
    assert got == [2.0, None, None]


def test_implicit_score(spark):
    df = spark.createDataFrame([(5.0,)], "raw double")
    row = df.select(implicit_score("raw").alias("log"), implicit_score("raw", False).alias("plain")).first()
    assert math.isclose(row.log, math.log1p(5.0)) and row.plain == 5.0
