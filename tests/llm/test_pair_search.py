"""Ranked search against scoring every document for every query."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from clickrank.llm import pair_search
from clickrank.llm.pair_search import SearchConfig

DOCS = "doc_id long, text string, terms string, rank int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, queries, k):
    bags = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in set(queries):
        scored = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    * (1_000_000_000 * bag[w] // (1000 * bag[w] + 12 * m)) for w, q in Counter(terms(text)).items() if bag[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ß", "x9", "A-b", "don't"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(600)]
    queries = [(i, text(rng.randint(1, 25))) for i in range(30)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + docs[:3] + [(None, docs[8][1]), (None, None), (2000, ""), (2001, " -- !")]
    docs += [(3000 + i, queries[i][1]) for i in range(10)] + [(4000, text(30_000)), (4001, "Ñ\x00ñ\x7fw1")]
    queries += [(50, None), (51, ""), (52, "nowhere"), (53, docs[5][1]), (53, docs[5][1]), (None, "w1 w2 w2"), (54, "W399 É")]
    return docs, queries


def test_against_brute_force(spark, corpus):
    docs, queries = corpus
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], DOCS).repartition(7)
    q = spark.createDataFrame([(*r, 1) for r in queries], "item_id long, text string, score int")
    for config in (SearchConfig(), SearchConfig(k=3, block_docs=16, set_terms=40), SearchConfig(k=1, block_bytes=500)):
        got = pair_search.search(pair_search.build_index(d, config), q, config)
        assert Counter(tuple(r) for r in got.collect()) == brute(docs, queries, config.k), config


def test_pair_bounds_hold_and_are_tighter(spark, corpus):
    """No group's bound lies below a score in its block, none above the sum of the term maxima, and some below it."""
    docs, queries = corpus
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], DOCS).repartition(2)
    index = pair_search.build_index(d, SearchConfig(block_docs=40))
    n_docs, n_terms = pair_search.corpus_size(index)
    rows = pair_search._asked(spark.createDataFrame(queries, "item_id long, text string")).collect()
    q = pair_search._Queries(rows, lambda t: pair_search.np.array([1000] * len(t)))
    tighter = 0
    for block in pair_search._impact_lists(index, q, n_docs, n_terms).collect():
        best, joint = pair_search.np.zeros(len(q.terms) + 1, int), pair_search.np.zeros(len(q.pairs) + 1, int)
        best[block.have], joint[block.met] = block.best, block.joint
        bound, at, lists = q.bounds(best, joint), 0, {}
        for term, n in zip(block.have, block.df):
            lists[term] = dict(zip(block.docs[at:at + n], block.impacts[at:at + n]))
            at += n
        for g in range(len(q.a)):
            a, b = lists.get(q.a[g], {}), lists.get(q.b[g], {})
            top = max((q.qa[g] * a.get(x, 0) + q.qb[g] * b.get(x, 0) for x in {*a, *b}), default=0)
            independent = q.qa[g] * best[q.a[g]] + q.qb[g] * best[q.b[g]]
            assert top <= bound[g] <= independent
            tighter += bound[g] < independent
    assert tighter > 100


def test_nothing(spark, corpus):
    docs = spark.createDataFrame([(1, None, "x", 1)], DOCS)
    q = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert pair_search.search(pair_search.build_index(docs), q).count() == 0
    full = pair_search.build_index(spark.createDataFrame([(1, "w1", "x", 1)], DOCS))
    assert pair_search.search(full, q.where("item_id < 0")).count() == 0


def test_large_rows_are_written_in_small_row_groups(spark, monkeypatch):
    """A task holds some megabytes of its index, not a row group of 100 blocks or more."""
    import pyarrow.parquet as pq

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000)), "x", 1) for i in range(60)], DOCS).coalesce(1)
    monkeypatch.setitem(pair_search.LARGE_ROWS, "parquet.block.size", str(1 << 18))
    index = pair_search.build_index(docs, SearchConfig(block_docs=2))
    path, = index.inputFiles()
    sizes = [pq.ParquetFile(path.removeprefix("file://")).metadata.row_group(i).num_rows for i in range(pq.ParquetFile(path.removeprefix("file://")).num_row_groups)]
    assert sum(sizes) == 30 and max(sizes) <= 8
    seen = []
    monkeypatch.setattr(pair_search, "written", lambda df, name, options=None: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    pair_search.build_index(docs, SearchConfig(batch_docs=7))
    assert seen == ["7"]
