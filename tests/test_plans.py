"""Preparation, sinks, experiments and summaries."""

from __future__ import annotations

from dataclasses import replace

import pytest

from clickrank.config import RecConfig
from clickrank.operators.als import recommend_als
from clickrank.operators.clean import clean_events
from clickrank.operators.evaluate import catalog_size, evaluate_recommendations
from clickrank.operators.popularity import recommend_popular
from clickrank.operators.cooccurrence import recommend_cooccurrence
from clickrank.operators.profile import dataset_profile
from clickrank.operators.split import build_train_test, temporal_split_events
from clickrank.plans.experiments import (
    best_by,
    fastest_partitions,
    model_experiment,
    partition_experiment,
    report_summary,
    scale_experiment,
    storage_summary,
)
from clickrank.plans.prepare import prepare_outputs, write_als_recommendations, write_recommendations
from clickrank.session import scratch_path
from clickrank.sources import orders_fixture, read_parquet, write_profile

from .conftest import SF_SMALL

FAST = replace(RecConfig(), als_ranks=(4,), als_reg_params=(0.1,), als_alphas=(10.0,), als_max_iter=2)


@pytest.fixture(scope="module")
def events(spark):
    ev = clean_events(orders_fixture(spark, SF_SMALL)).persist()
    yield ev
    ev.unpersist()


@pytest.fixture(scope="module")
def split(events):
    tt = build_train_test(events)
    yield tt
    tt.release()


def test_prepare_outputs_round_trip(spark, events):
    base = scratch_path(spark, "test-prepare")
    paths = prepare_outputs(events, base)
    assert read_parquet(spark, paths["events_clean"]).count() == events.count()
    assert read_parquet(spark, paths["test_relevant_items"]).columns == ["visitorid", "itemid"]
    arrays = prepare_outputs(events, base + "-arrays", relevant_format="arrays")
    assert read_parquet(spark, arrays["test_relevant_items"]).columns == ["visitorid", "relevant_items"]


def test_list_sinks(spark, split):
    base = scratch_path(spark, "test-lists")
    write_recommendations(recommend_popular(split.train, 5), f"{base}/popularity.parquet")
    lists = read_parquet(spark, f"{base}/popularity.parquet")
    assert lists.count() == split.train.select("visitorid").distinct().count()
    users = split.relevant.select("visitorid")
    by_rank = {r: recommend_als(split.train, users, 5, r, 0.1, 10.0, 2)[0] for r in (2, 4)}
    write_als_recommendations(by_rank, f"{base}/als.parquet")
    als = read_parquet(spark, f"{base}/als.parquet")
    assert sorted(r.als_rank for r in als.select("als_rank").distinct().collect()) == [2, 4]


def test_profile_sink(spark, events):
    base = scratch_path(spark, "test-profile")
    write_profile(dataset_profile(events), f"{base}/csv", f"{base}/kv")
    assert spark.read.option("header", True).csv(f"{base}/csv").count() == 1
    assert spark.read.option("header", True).csv(f"{base}/kv").count() == 13


def test_population_option(spark, split):
    recs = recommend_cooccurrence(split.train, 10)
    listed = evaluate_recommendations(recs, split.relevant, catalog_size(split.train), 10).first()
    everyone = evaluate_recommendations(recs, split.relevant, catalog_size(split.train), 10,
                                        population="all_relevant").first()
    assert everyone.test_users == split.relevant.select("visitorid").distinct().count()
    assert everyone.test_users >= listed.test_users
    assert everyone.precision_at_10 * everyone.test_users == pytest.approx(listed.precision_at_10 * listed.test_users)


def test_approx_cutoff_option(split, events):
    train, test, cutoff = temporal_split_events(events, 0.8, method="approx")
    assert train.count() + test.count() == events.count()
    with pytest.raises(ValueError):
        temporal_split_events(events, 0.8, method="nope")


def test_model_experiment_timed_and_best(spark, split):
    rows = model_experiment(split.train, split.relevant, FAST, ["popularity", "cooccurrence", "als"], timed=True)
    got = {r.model: r for r in rows.collect()}
    assert set(got) == {"popularity", "cooccurrence", "als_rank4"}
    assert all(r.total_time_seconds >= 0 for r in got.values())
    best = {r.metric: r for r in best_by(rows).collect()}
    assert best["precision"].value == max(r.precision for r in got.values())


def test_scale_and_partition_experiments(spark, events):
    scale = scale_experiment(events, FAST, fractions=(0.5, 1.0)).collect()
    assert [r.fraction for r in sorted(scale, key=lambda r: r.fraction)] == [0.5, 1.0]
    assert all(r.model == "popularity" for r in scale)
    parts = partition_experiment(events, FAST, partitions=(2, 5), timed=True)
    rows = parts.collect()
    assert len({(round(r.precision, 12), round(r.recall, 12)) for r in rows}) == 1
    fastest = fastest_partitions(parts).first()
    assert fastest.partitions in (2, 5)


def test_summaries(spark, events, split):
    models = model_experiment(split.train, split.relevant, FAST, ["popularity"])
    scale = scale_experiment(events, FAST, fractions=(1.0,))
    summary = report_summary(dataset_profile(events), models, scale).first()
    assert summary.models == "popularity" and summary.fractions == "1.0"
    storage = spark.createDataFrame([("csv", 1.5), ("parquet", 0.5)], "format string, read_time_seconds double")
    assert storage_summary(storage).count() == 2


def test_partition_experiment_computes_its_events_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    raw = spark.createDataFrame([(1000 * (60 * u + i), u, "view" if i < 5 else "transaction", i % 6, None) for u in range(6) for i in range(7)],
                                "timestamp long, visitorid int, event string, itemid int, transactionid string")
    events = clean_events(raw.mapInArrow(counted, raw.schema))
    rows = partition_experiment(events, FAST, partitions=(2, 3)).collect()
    assert computed.value == 42 and [r.input_rows for r in rows] == [42, 42]
    assert not events.storageLevel.useMemory
