"""Benchmark: the reference's headline workloads on the orders fixture.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is timed around
the action that produces its result:

* prepare      - fixture -> clean events (persisted) -> exact split -> train/relevant
* profile      - dataset profile of the clean events
* popularity   - lists + evaluation
* cooccurrence - lists + evaluation
* als_rank8 / als_rank16 - fit, lists for relevant users, evaluation
* partitions_{2,4,8,16}  - popularity at 25 % of users, sample repartitioned n ways
                           (split + lists + evaluation; the partition experiment)
* storage_write          - raw events to CSV and clean events to Parquet
* csv_count / parquet_count - read + count of those copies

als_rank8, als_rank16), partition table (partitions_n), CSV vs Parquet
read+count (csv_count, parquet_count).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickrank.config import RecConfig  # noqa: E402
from clickrank.operators.als import recommend_als  # noqa: E402
from clickrank.operators.clean import clean_events  # noqa: E402
from clickrank.operators.cooccurrence import recommend_cooccurrence  # noqa: E402
from clickrank.operators.evaluate import catalog_size, evaluate_recommendations  # noqa: E402
from clickrank.operators.popularity import recommend_popular  # noqa: E402
from clickrank.operators.profile import dataset_profile  # noqa: E402
from clickrank.operators.split import build_train_test, materialize  # noqa: E402
from clickrank.plans.prepare import prepare_train_test  # noqa: E402
from clickrank.session import get_session, scratch_path  # noqa: E402
from clickrank.sources import orders_fixture, read_events, read_parquet, write_csv, write_parquet  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app_name="clickrank-bench", shuffle_partitions=2 * cpus,
                        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    config = RecConfig()
    k = config.k
    times: dict[str, float] = {}
    extra: dict[str, object] = {}

    def timed(name, fn):
        started = time.perf_counter()
        result = fn()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    raw = orders_fixture(spark, sf_dir)

    def prepare():
        events = materialize(clean_events(raw, config.event_weights))
        extra["clean_events"] = events.count()
        split = build_train_test(events, config.train_ratio, config.use_log_score, config.min_user_interactions,
                                 config.min_item_interactions, config.relevant_events,
                                 config.fallback_relevant_events)
        extra["train_rows"] = split.train.count()
        extra["relevant_pairs"] = split.relevant.count()
        return events, split

    events, split = timed("prepare", prepare)
    timed("profile", lambda: dataset_profile(events).collect())
    catalog = catalog_size(split.train)

    def evaluate(recs, relevant=split.relevant, catalog=catalog):
        recs = recs.persist()
        row = evaluate_recommendations(recs, relevant, catalog, k).first().asDict()
        recs.unpersist()
        return row

    extra["popularity"] = timed("popularity", lambda: evaluate(
        recommend_popular(split.train, k, config.exclude_seen)))
    extra["cooccurrence"] = timed("cooccurrence", lambda: evaluate(recommend_cooccurrence(
        split.train, k, config.max_items_per_user_for_pairs, config.top_similar_items_per_item)))
    users = split.relevant.select("visitorid").distinct()
    for rank in (8, 16):
        extra[f"als_rank{rank}"] = timed(f"als_rank{rank}", lambda rank=rank: evaluate(recommend_als(
            split.train, users, k, rank, config.als_reg_params[0], config.als_alphas[0], config.als_max_iter)[0]))
    for n in config.partitions:
        def partition_run(n=n):
            prepared = prepare_train_test(events, config, config.fractions[0], n)
            part = prepared.split
            row = evaluate(recommend_popular(part.train, k, config.exclude_seen),
                           part.relevant, catalog_size(part.train))
            part.release()
            return row
        extra[f"partitions_{n}"] = timed(f"partitions_{n}", partition_run)

    csv_path, parquet_path = scratch_path(spark, "bench-csv"), scratch_path(spark, "bench-parquet")

    def write_copies():
        write_csv(raw, csv_path)
        write_parquet(events, parquet_path)

    timed("storage_write", write_copies)
    extra["csv_rows"] = timed("csv_count", lambda: read_events(spark, csv_path).count())
    extra["parquet_rows"] = timed("parquet_count", lambda: read_parquet(spark, parquet_path).count())

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "details": extra,
    }, default=str))
    split.release()
    events.unpersist()
    spark.stop()


if __name__ == "__main__":
    main()
