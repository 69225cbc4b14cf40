"""Sums of packed candidate arrays and the co-occurrence lists built on them, against plain counting."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from clickrank.operators.cooccurrence import pair_support, recommend_cooccurrence, top_similar
from clickrank.operators.packed import packed_sums


@pytest.fixture(params=["3"])
def batches(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a key's rows may come in many batches
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def first(pairs: Counter, n: int) -> dict:
    """The first n of each key, by count desc, candidate asc."""
    out: dict = {}
    for (k, c), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1])):
        if sum(1 for x in out if x[0] == k) < n:
            out[k, c] = s
    return out


@pytest.mark.parametrize("hot, weighted", [((), False), ((0, 3), True)])
def test_packed_sums(spark, batches, hot, weighted):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        items = [rng.randint(-5, 30) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([None, *range(8)]), rng.choice([None, *range(-3, 10)]), items, [rng.randint(1, 4) for _ in items] if weighted else None))
    want = Counter()
    for k, _, items, amounts in rows:
        for n, c in enumerate(items):
            want[k, c] += amounts[n] if weighted else 1
    for k, own, _, _ in rows:
        want.pop((k, own), None)
    frame = spark.createDataFrame(rows, "k int, own int, candidates array<int>, amounts array<long>").repartition(3)
    got = {(r.k, r.c): r.n for r in packed_sums(frame, "k", "c", "n", hot, step=7).collect()}
    assert got == dict(want)
    few = {(r.k, r.c): r.n for r in packed_sums(frame, "k", "c", "n", hot, best=2, step=7).collect()}
    kept = first(want, 2)
    assert {x: few[x] for x in kept} == kept
    assert hot or few == kept


def plain_lists(pairs, k: int) -> set:
    held: dict = {}
    for u, i in pairs:
        held.setdefault(u, []).append(i)
    support = Counter((a, b) for items in held.values() for a in items for b in items if a != b)
    near = first(support, 50)
    out = set()
    for u, items in held.items():
        score = Counter()
        for (a, b), s in near.items():
            score[b] += s * items.count(a)
        free = sorted((-s, b) for b, s in score.items() if s and b not in items)
        out |= {(u, r + 1, b) for r, (_, b) in enumerate(free[:k])}
    return out


def test_no_row_per_pair_is_shuffled(spark, batches):
    rng = random.Random(5)
    pairs = [(u, i) for u in range(25) for i in rng.sample(range(40), rng.randint(1, 12))] + [(99, i) for i in range(30)]
    train = spark.createDataFrame(pairs, "visitorid int, itemid int")
    counted = pair_support(train, None, len(pairs))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "item_a" not in plan  # the pairs were aggregated by a shuffle of a row each
    best = {(r.itemid, r.candidate_itemid, r.similarity) for r in top_similar(counted, 4).collect()}
    trimmed = pair_support(train, None, len(pairs), best=4)
    assert {(r.itemid, r.candidate_itemid, r.similarity) for r in trimmed.collect()} == best
    got = {(r.visitorid, r["rank"], r.itemid) for r in recommend_cooccurrence(train, 5).long.collect()}
    assert got == plain_lists(pairs, 5)


def test_blocked_and_hot_histories(spark, monkeypatch):
    from clickrank.operators import cooccurrence

    rng = random.Random(6)
    pairs = [(u, i) for u in range(12) for i in rng.sample(range(50), rng.randint(1, 8))] + [(77, i) for i in range(45)]
    train = spark.createDataFrame(pairs, "visitorid int, itemid int")
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", 10)
    spark.conf.set("spark.clickrank.skew.minHotRows", "3")
    try:
        got = {(r.visitorid, r["rank"], r.itemid) for r in recommend_cooccurrence(train, 5).long.collect()}
    finally:
        spark.conf.unset("spark.clickrank.skew.minHotRows")
    assert got == plain_lists(pairs, 5)


def test_lists_in_passes(spark, monkeypatch):
    """Passes over parts of items and users give the same lists, and leave neither shuffle files nor helper tables."""
    from pathlib import Path

    from clickrank.operators import cooccurrence

    rng = random.Random(7)
    pairs = [(u, i) for u in range(40) for i in rng.sample(range(50), rng.randint(1, 9))] + [(77, i) for i in range(45)]
    train = spark.createDataFrame(pairs, "visitorid int, itemid int")
    monkeypatch.setattr(cooccurrence, "PASS_CANDIDATES", 100)
    monkeypatch.setattr(cooccurrence, "ROW_CANDIDATES", 2)
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", 10)
    sizes = []
    real = cooccurrence._in_passes
    monkeypatch.setattr(cooccurrence, "_in_passes", lambda t, name, n, build: sizes.append(n) or real(t, name, n, build))
    got = recommend_cooccurrence(train, 5)
    assert {(r.visitorid, r["rank"], r.itemid) for r in got.long.collect()} == plain_lists(pairs, 5)
    assert len(sizes) == 3 and min(sizes[1:]) > 3
    left = {p.name.rsplit("-", 1)[0] for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir()}
    assert not left & {"cooc-histories", "cooc-neighbours"}


def test_a_pair_is_sent_once(spark, monkeypatch):
    """Supports of all pairs are counted at the lower item: half the candidates, the same rows in both orders."""
    from clickrank.operators import cooccurrence

    rng = random.Random(8)
    pairs = [(u, i) for u in range(30) for i in rng.sample(range(-9, 40), rng.randint(1, 12))] + [(99, i) for i in range(30)] + [(5, 3), (5, 3), (5, 4)]
    train = spark.createDataFrame(pairs, "visitorid int, itemid int")
    held: dict = {}
    for u, i in pairs:
        held.setdefault(u, []).append(i)
    want = Counter((a, b) for items in held.values() for a in items for b in items if a != b)
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", 10)
    sent = []
    real = cooccurrence.packed_sums
    monkeypatch.setattr(cooccurrence, "packed_sums", lambda rows, *a: sent.append(sum(len(r.candidates) for r in rows.collect())) or real(rows, *a))
    got = {(r.itemid, r.candidate_itemid): r.similarity for r in pair_support(train).collect()}
    assert got == dict(want)
    assert sent[0] <= (sum(want.values()) + len(pairs)) / 2
