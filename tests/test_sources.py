"""Sources and sinks: CSV schema handling, multi-file scans, result sinks, round trips."""

from __future__ import annotations

import os


from clickrank.operators.clean import clean_events
from clickrank.operators.profile import dataset_profile
from clickrank.plans.experiments import storage_experiment
from clickrank.sources import (
    events_fixture,
    profile_as_key_values,
    read_events,
    read_item_properties,
    write_metrics_csv,
)

from .conftest import SF_SMALL


def test_malformed_csv_fields_become_null_and_are_dropped(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        "timestamp,visitorid,event,itemid,transactionid\n"
        "1000,1,view,10,\n"
        "oops,1,view,11,\n"
        "2000,99999999999,view,12,\n"
        "3000,2,transaction,13,t9\n"
        "3000,2,transaction,13,t9\n"
        "4000,3,VIEW,14,\n"
    )
    raw = read_events(spark, str(path))
    assert raw.count() == 6
    clean = clean_events(raw)
    assert sorted((r.visitorid, r.itemid) for r in clean.collect()) == [(1, 10), (2, 13)]


def test_item_properties_multi_file(spark, tmp_path):
    for i, rows in enumerate([["0,1,brand,a"], ["0,2,type,b", "5,3,size,7"]]):
        (tmp_path / f"p{i}.csv").write_text("timestamp,itemid,property,value\n" + "\n".join(rows) + "\n")
    df = read_item_properties(spark, [str(tmp_path / "p0.csv"), str(tmp_path / "p1.csv")])
    assert sorted(r.itemid for r in df.collect()) == [1, 2, 3]


def test_metrics_sink_writes_nothing_for_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert write_metrics_csv(empty, str(tmp_path / "none")) is False
    assert not os.path.exists(tmp_path / "none")
    assert write_metrics_csv(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "one")) is True
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 1


def test_profile_and_key_values(spark):
    prof = dataset_profile(clean_events(events_fixture(spark, SF_SMALL)))
    row = prof.first()
    assert row.total_events == row.total_views + row.total_addtocart + row.total_transactions
    assert 0.0 <= row.sparsity_estimate <= 1.0
    kv = profile_as_key_values(prof)
    assert kv.count() == len(prof.columns)


def test_storage_round_trip(spark):
    raw = events_fixture(spark, SF_SMALL)
    clean = clean_events(raw)
    rows = {r.format: r for r in storage_experiment(raw, clean, timed=True).collect()}
    assert rows["csv"].rows == raw.count()
    assert rows["parquet"].rows == clean.count()
    assert rows["csv"].disk_size_mb > 0 and rows["parquet"].disk_size_mb > 0
    assert rows["csv"].read_time_seconds >= 0
