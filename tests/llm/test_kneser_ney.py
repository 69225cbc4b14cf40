"""The sharded language model against a plain one in dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickrank.llm import kneser_ney
from clickrank.llm.kneser_ney import LmConfig

DOCS = "doc_id long, text string, score string, chunk int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START = "</s>", "<s>"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [END]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            words = tokens(t)
            self.uni.update(words)
            self.bi.update(zip([START] + words, words))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.context, self.kinds = Counter(), defaultdict(Counter)
        for (v, _), c in self.bi.items():
            self.context[v] += c
            self.kinds[v][min(c, 3)] += 1
        self.before = Counter(w for _, w in self.bi)
        self.d, self.low = (kneser_ney.discounts(*[sum(c == i for c in x.values()) for i in (1, 2, 3, 4)]) for x in (self.bi, self.before))

    def p1(self, w):
        if not self.bi:
            return 1 / (self.v + 1)
        rest = sum(self.low[min(a, 3) - 1] for a in self.before.values()) / (self.v + 1)
        a = self.before[w]
        return ((a - self.low[min(a, 3) - 1] if a else 0) + rest) / len(self.bi)

    def p(self, v, w):
        if not self.context[v]:
            return self.p1(w)
        c = self.bi[v, w]
        rest = sum(self.d[k - 1] * n for k, n in self.kinds[v].items())
        return ((c - self.d[min(c, 3) - 1] if c else 0) + rest * self.p1(w)) / self.context[v]

    def row(self, i, text):
        words = tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in words)
        return (i, len(words), sum(w in self.uni for w in words), base,
                sum(math.log10(self.p(v, w)) for v, w in zip([START] + words, words)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "x,", "Foo", "foo", "</s>x"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights, k=n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(300)]
    rows += [(1000 + i, "hot pair " * 30) for i in range(150)] + rows[:4] + [(None, text(9)), (None, None), (2000, ""), (2001, " \n")]
    return rows + [(3000, text(20_000)), (3001, "nothing of this is known"), (3002, "a b")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_against_plain_model(spark, texts):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in texts], DOCS).repartition(6)
    plain = Plain([t for i, t in texts if not held(i)])
    want = sorted((plain.row(*r) for r in texts), key=str)
    # many shards and chunks, so that contexts lie across shards; one of each; and parts of the vocabulary
    for config in (LmConfig(500, 64, 1 << 12), LmConfig(), LmConfig(3000, 7, 1 << 30)):
        got = kneser_ney.score_held_out(docs, config).collect()
        assert all(r.held_out == held(r.doc_id) and r.train_tokens == plain.n for r in got)
        rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=str)
        assert [r[:3] for r in rows] == [r[:3] for r in want], config
        assert np.allclose([r[3:] for r in rows], [r[3:] for r in want], rtol=1e-9), config


def test_probabilities_sum_to_one(texts):
    plain = Plain([t for _, t in texts])
    for v in (START, "w1", "hot", "never"):
        assert abs(sum(plain.p(v, w) for w in plain.uni) + plain.p(v, "unknown") - 1) < 1e-9


def test_model_beats_the_base(spark, texts):
    rows = kneser_ney.score_held_out(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark):
    held_out = next(i for i in range(99) if held(i))
    docs = spark.createDataFrame([(held_out, "a b"), (held_out, None)], "doc_id long, text string")
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in kneser_ney.score_held_out(docs).collect()) \
        == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert kneser_ney.score_held_out(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_packing(numbers):
    a = np.array(sorted(numbers), np.uint64)
    assert (kneser_ney._unpack_sorted(kneser_ney._pack_sorted(a)) == a).all()
    b = np.array(numbers, np.int64)
    assert (kneser_ney._unpack(kneser_ney._pack(b), np.int64) == b).all()
