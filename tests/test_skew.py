"""A hot key (one item in a third of all rows) must be split by AQE, not land in one task."""

from __future__ import annotations

import io
from contextlib import redirect_stdout


from clickrank.operators.cooccurrence import candidate_scores, pair_support, top_similar


def _hot_train(spark):
    # 600 users; every user has item 0 (a third of the rows) plus two items of their own group
    rows = []
    for u in range(600):
        for item in (0, 1 + u % 50, 51 + u % 37):
            rows.append((u, item, 1.0))
    return spark.createDataFrame(rows, "visitorid int, itemid int, score double")


def test_hot_item_join_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        "spark.clickrank.skew.minHotRows": "10",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        train = _hot_train(spark)
        neighbours = top_similar(pair_support(train, 100), 50)
        scores = candidate_scores(train, neighbours)
        result = {(r.visitorid, r.candidate_itemid): r.score for r in scores.collect()}
        buf = io.StringIO()
        with redirect_stdout(buf):
            scores.explain()
        plan = buf.getvalue()
        assert "_salt" in plan  # the hot item is salted explicitly
        assert "skew=true" in plan  # and both join sides are now plain shuffles AQE can split
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # brute force on the same input
    hist = {}
    for u, i, _ in [tuple(r) for r in train.collect()]:
        hist.setdefault(u, set()).add(i)
    sim = {}
    for items in hist.values():
        for a in items:
            for b in items:
                if a != b:
                    sim[(a, b)] = sim.get((a, b), 0) + 1
    top = {}
    for (a, b), s in sim.items():
        top.setdefault(a, []).append((-s, b))
    top = {a: sorted(v)[:50] for a, v in top.items()}
    expected = {}
    for u, items in hist.items():
        for i in items:
            for neg, c in top.get(i, []):
                if c not in items:
                    expected[(u, c)] = expected.get((u, c), 0) - neg
    assert result == expected


def test_salted_join_equals_plain_join(spark):
    from clickrank.operators.skew import hot_keys, key_counts, salted_join

    big = spark.createDataFrame([(k if i % 3 else 7, i) for i, k in enumerate(range(300))], "k int, v int")
    small = spark.createDataFrame([(7, "a"), (7, "b"), (5, "c"), (400, "d")], "k int, w string")
    assert hot_keys(key_counts(big, "k"), "k") == []  # below the absolute floor
    hot = hot_keys(key_counts(big, "k"), "k", min_rows=10)
    assert hot == [7]
    for how in ("inner", "left_semi", "left_anti"):
        plain = sorted(tuple(r) for r in big.join(small, "k", how).collect())
        salted = sorted(tuple(r) for r in salted_join(big, small, "k", how, hot=hot, salts=5).collect())
        assert plain == salted, how
