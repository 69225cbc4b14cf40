"""Sums of wide codes and what is sent to the workers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from clickrank.operators import packed
from clickrank.operators.packed import first_of_runs, packed_sums, summed


def test_no_null_lists_go_to_workers(spark):
    rows = spark.createDataFrame([(1, 1, [2, 3], None), (1, 1, [3], None)], "k int, own int, candidates array<int>, amounts array<long>")
    sums = packed_sums(rows, "k", "c", "n")
    assert "coalesce(amounts" in sums._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in sums.collect()) == [(1, 2, 1), (1, 3, 2)]


@pytest.mark.parametrize("least, most", [(1, 4), (0, 2**40), (-2**40, 2**40)])
def test_sums_and_best_of_wide_codes(least, most):
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        run = np.sort(rng.integers(0, rng.choice([3, 2**31 - 1]), n))
        code, amount = packed.codes(run, rng.integers(-2**31, 2**31, n) // rng.choice([1, 2**29])), rng.integers(least, most, n)
        want = Counter()
        for c, a in zip(code.tolist(), amount.tolist()):
            want[c] += a
        got = summed(code, amount)
        assert list(zip(*(x.tolist() for x in got))) == sorted(want.items())
        counted = summed(code, None)
        assert list(zip(*(x.tolist() for x in counted))) == sorted(Counter(code.tolist()).items())
        best = sorted(want, key=lambda c: (c >> 32, -want[c], c))
        best = [c for i, c in enumerate(best) if sum(x >> 32 == c >> 32 for x in best[:i]) < 2]
        assert [(int(r) << 32) + int(v) + 2**31 for r, v, _ in zip(*first_of_runs(*got, code[:0], 2))] == best
