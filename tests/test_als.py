"""Masked block top-k and the optimality of the fit, against NumPy over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickrank.operators.als import ALSSettings, fit_grid, gram, recommend_from_model, user_optimality
from clickrank.operators.blocktopk import BlockSize, Lists, Seen, masked_top_k


def brute(users, items, seen, k):
    out = set()
    for u, x in users.items():
        scored = sorted((-float(np.float32(np.dot(np.float64(x), np.float64(y)))), i) for i, y in items.items() if (u, i) not in seen)
        out |= {(u, r + 1, i) for r, (_, i) in enumerate(scored[:k])}
    return out


@pytest.fixture(params=["10000", "7"])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a cell's rows may come in many batches
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [BlockSize(), BlockSize(7, 11, 3), BlockSize(1000, 1, 1)])
def test_masked_top_k(spark, size, batches):
    rng = np.random.default_rng(4)
    # small integers, so that products tie often; one user has seen all but two items, one everything, one nothing
    users = {u: rng.integers(0, 3, 4).astype(float).tolist() for u in range(40)} | {90: [0.0] * 4}
    items = {i: rng.integers(0, 3, 4).astype(float).tolist() for i in range(60)}
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 38, 300), rng.integers(0, 60, 300))}
    seen |= {(38, i) for i in range(58)} | {(39, i) for i in range(60)}
    extra = [(999, 1), (3, 999), *list(seen)[:5]]  # unknown users and items, repeated pairs
    frame = lambda of, name: spark.createDataFrame([(k, v) for k, v in of.items()], f"{name} int, features array<float>").repartition(3)
    pairs = spark.createDataFrame([*seen, *extra], "visitorid int, itemid int")
    for k in (1, 5, 100):
        got = masked_top_k(frame(users, "visitorid"), frame(items, "itemid"), pairs, k, size)
        assert {(r.visitorid, r.rank, r.itemid) for r in got.collect()} == brute(users, items, seen, k)
    got = masked_top_k(frame(users, "visitorid"), frame(items, "itemid"), None, 5, size)
    assert {(r.visitorid, r.rank, r.itemid) for r in got.collect()} == brute(users, items, set(), 5)


def test_users_meet_few_of_the_items():
    rng = np.random.default_rng(9)
    x, y = rng.random((300, 8)), rng.random((40_000, 8)) * rng.random((40_000, 1))
    y = y[np.argsort(-(y * y).sum(axis=1))]
    ids = rng.permutation(40_000).astype(np.int32)
    held, masked = rng.integers(0, 300, 5000).astype(np.int32), rng.integers(0, 40_000, 5000).astype(np.int32)
    lists = Lists(np.arange(300, dtype=np.int32), x, held, masked, 10, 64)
    met = sum(lists.add(ids[s:s + 1000], y[s:s + 1000]) for s in range(0, 40_000, 1000))
    scores = (x @ y.T).astype(np.float32)
    column = np.argsort(ids)
    scores[held, column[masked]] = -np.inf
    assert all(np.array_equal(lists.item[u], ids[np.lexsort((ids, -scores[u]))[:10]]) for u in range(300))
    assert met < 0.3 * scores.size  # all products were computed before


def test_signed_factors(spark):
    rng = np.random.default_rng(10)
    users = {u: rng.integers(-2, 3, 3).astype(float).tolist() for u in range(20)}
    items = {i: rng.integers(-2, 3, 3).astype(float).tolist() for i in range(50)}
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 20, 100), rng.integers(0, 50, 100))}
    frame = lambda of, name: spark.createDataFrame([(k, v) for k, v in of.items()], f"{name} int, features array<float>")
    pairs = spark.createDataFrame([*seen], "visitorid int, itemid int")
    got = masked_top_k(frame(users, "visitorid"), frame(items, "itemid"), pairs, 4, BlockSize(100, 5, 3))
    assert {(r.visitorid, r["rank"], r.itemid) for r in got.collect()} == brute(users, items, seen, 4)


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "visitorid int, features array<float>")
    items = spark.createDataFrame([(1, [1.0])], "itemid int, features array<float>")
    assert masked_top_k(none, items, None, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0])], "visitorid int, features array<float>")
    assert masked_top_k(some, items.where("itemid < 0"), None, 3).count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(8)
    rows = {(int(u), int(i)): float(s) for u, i, s in zip(rng.integers(0, 30, 400), rng.integers(0, 40, 400), rng.random(400) * 3)}
    train = spark.createDataFrame([(u, i, s) for (u, i), s in rows.items()], "visitorid int, itemid int, score double").cache()
    settings = ALSSettings(rank=5, regParam=0.05, alpha=10.0, maxIter=4)
    return fit_grid(train, [settings])[0], train, rows, settings


def test_lists_of_a_model(spark, fitted):
    model, train, rows, _ = fitted
    users = {r.id: list(r.features) for r in model.userFactors.collect()}
    items = {r.id: list(r.features) for r in model.itemFactors.collect()}
    asked = train.select("visitorid").union(spark.createDataFrame([(777,)], "visitorid int"))
    recs = recommend_from_model(model, train, asked, 6)
    assert {tuple(r) for r in recs.long.select("visitorid", "rank", "itemid").collect()} == brute(users, items, set(rows), 6)
    assert {r.visitorid for r in recs.users.collect()} == set(users)


def test_optimality(fitted):
    model, train, rows, settings = fitted
    assert user_optimality(model, train, settings).agg(F.max("residual")).first()[0] < 1e-4
    y = np.array([r.features for r in model.itemFactors.orderBy("id").collect()], float)
    assert np.allclose(gram(model.itemFactors, 5), y.T @ y)
    # the residuals are those of the whole normal equations; other settings are not optimal
    wrong = ALSSettings(rank=5, regParam=0.05, alpha=20.0, maxIter=4)
    got = {r.visitorid: r.residual for r in user_optimality(model, train, wrong).collect()}
    ids = {r.id: n for n, r in enumerate(model.itemFactors.orderBy("id").collect())}
    for r in model.userFactors.collect():
        x, own = np.array(r.features, float), [(ids[i], 20.0 * float(np.float32(s))) for (u, i), s in rows.items() if u == r.id]
        a = y.T @ y + sum(c * np.outer(y[i], y[i]) for i, c in own) + 0.05 * len(own) * np.eye(5)
        g = a @ x - sum((1 + c) * y[i] for i, c in own)
        assert np.isclose(got[r.id], max(abs(min(v, h / d)) for v, h, d in zip(x, g, np.diag(a))) / max(x), rtol=1e-6)
    assert max(got.values()) > 1e-3


def test_a_worker_holds_four_bytes_for_a_seen_pair():
    """Batches of pairs go once their items are copied, and blocks follow the pairs too."""
    import tracemalloc

    ids = np.arange(0, 2000, 2, dtype=np.int32)
    held = np.sort(np.random.default_rng(3).integers(0, 2000, 1_000_000)).astype(np.int32)
    masked = np.arange(1_000_000, dtype=np.int32)
    tracemalloc.start()
    seen = Seen(ids)
    for s in range(0, len(held), 10_000):
        seen.add(held[s:s + 10_000], masked[s:s + 10_000])
    lists = Lists(ids, np.ones((1000, 4), np.float32), held[:0], masked[:0], 5, 64, seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = held % 2 == 0
    assert np.array_equal(lists.masked, masked[known]) and np.array_equal(np.diff(lists.first), np.bincount(held[known] // 2, minlength=1000))
    assert peak < 9 * known.sum()  # once in parts, once as a whole


def test_blocks_follow_the_seen_pairs(spark):
    users = spark.createDataFrame([(u, [1.0, float(u)]) for u in range(20)], "visitorid int, features array<float>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "itemid int, features array<float>")
    seen = spark.createDataFrame([(u, i) for u in range(20) for i in range(10)], "visitorid int, itemid int")
    one, many = (masked_top_k(users, items, seen, 4, size) for size in (BlockSize(), BlockSize(pairs=50)))
    assert (one.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 4)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
