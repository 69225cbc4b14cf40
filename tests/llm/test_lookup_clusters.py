"""Lookup-table clustering against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np

from clickrank.llm import lookup_clusters
from clickrank.llm.lookup_clusters import ClusterConfig

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, distance string"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in placed:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in placed)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(i, rows[i][1]) for i in range(5)] + [(500 + i, rows[7][1]) for i in range(60)]  # repeated rows and a hot vector
    rows += [(None, rows[3][1]), (900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, math.nan, 0.0, 0.0]),
             (904, [math.inf, 0.0, 0.0, 0.0]), (905, [0.5] * 3), (906, [-0.0] * 4), (907, [1e4, -1e4, 0.015625, -0.015625])]
    frame = spark.createDataFrame([(i, e, 1, "x", None, "clash") for i, e in rows], SCHEMA).repartition(5)
    for k, rounds in ((6, 3), (400, 1), (1, 2)):
        got = lookup_clusters.cluster(frame, ClusterConfig(k, rounds, 4))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == brute(rows, k, rounds, 4), (k, rounds)


def test_tables(spark):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-40, 40, (50, 7)).astype(np.int32), rng.integers(-40, 40, (3, 7))
    assert (lookup_clusters.distances(x, c) == ((x[:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2)).all()


def test_nothing_to_cluster(spark):
    for rows in ([], [(1, None, 1, "x", None, "y")]):
        out = lookup_clusters.cluster(spark.createDataFrame(rows, SCHEMA), ClusterConfig(dims=4))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "cluster"]


def test_huge_values_stay_within_bounds(spark):
    frame = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in lookup_clusters.cluster(frame, ClusterConfig(1, 0, 2)).collect()}
    assert max(r.distance for r in rows.values()) == 2 * lookup_clusters.BOUND ** 2
