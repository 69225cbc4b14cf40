"""What the operators leave on the driver and on disk: shuffle files, texts in shuffles, broadcasts, stages."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import pyspark
import pytest
from pyspark.sql import functions as F

from clickrank.llm import jaccard_join, quality_rules, suffix_dedup
from clickrank.llm.common import settled, shuffles_dropped, written

DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(blocks.size()) if (f := blocks.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.skipif(tuple(map(int, pyspark.__version__.split(".")[:2])) < (4, 1), reason="the setting came with 4.1")
def test_written_tables_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(DROPPED)
    kept = []
    for write in (lambda d: written(d, "t"), lambda d: settled(spark, "t", lambda: d)):
        kept.append(spark.range(1000).withColumn("k", F.col("id") % 50).groupBy("k").count())
        assert write(kept[-1]).count() == 50
    end = time.time() + 10
    # the counts themselves shuffle one row a file; what the writes shuffled is gone though the frames are still held
    while len(shuffle_files(spark) - before) > 4 and time.time() < end:
        time.sleep(0.2)
    assert len(shuffle_files(spark) - before) <= 4
    assert spark.conf.get(DROPPED) == was
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        raise ZeroDivisionError
    assert spark.conf.get(DROPPED) == was


def test_labels_meet_statistics_not_texts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda labelled, config: plans.append(
        labelled._jdf.queryExecution().executedPlan().toString()) or [])
    long = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, None, "c"), (None, long + " end", "d"), (3, "short", "e")],
                                 "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0)], "doc_id long, quality int")
    out = quality_rules.keep_quality(docs, labels)
    assert "text#" not in plans[0]
    assert out.columns == docs.columns
    assert sorted(r.stats for r in out.collect()) == ["a", "b", "d"]


def test_suffix_dedup_broadcasts_nothing_by_count(spark, monkeypatch):
    def refuse(_):
        raise AssertionError("what repeats grows with the corpus")

    monkeypatch.setattr(F, "broadcast", refuse)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = noise(500)
    texts = [noise(300) + shared + noise(90), shared, noise(700), None, "", noise(900), shared[:399]]
    rows = [*enumerate(texts), (None, texts[5]), (5, texts[5]), (0, shared + shared)]
    got = Counter(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + 400] for d in data for i in range(len(d) - 399))
    want = Counter()
    for (doc, _), d in zip(rows, data):
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if seen[d[i:i + 400]] > 1:
                gone[i:i + 400] = [True] * 400
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want[doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_jaccard_stars_take_few_jobs(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    near = [[*base[:k], f"x{k}", *base[k + 1:]] for k in range(0, 120, 3)]
    other = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 60))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, *near, *other, *near[:3]])]
    spark.sparkContext.setJobGroup("jaccard-jobs", "")
    try:
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("jaccard-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sets = [{tuple(t.split()[i:i + 3]) for i in range(max(1, len(t.split()) - 2))} if t else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(map(tuple, got.collect())) == [(i, len(s), find(i)) for i, s in enumerate(sets)]
    assert jobs < 190
