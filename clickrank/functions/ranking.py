"""Per-list ranking metrics (E1-E4) as array expressions.

Each takes a recommended-list column (array, ordered best first), a relevant
column (array; duplicates ignored) and k, and returns a double column.  The
set-based evaluation over whole tables lives in ``operators.evaluate`` and
uses the long form; these are for lists that are already arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _top(rec: Column, k: int) -> Column:
    return F.slice(F.coalesce(rec, F.array()), 1, k)


def _relevant(rel: str | Column) -> Column:
    return F.array_distinct(F.coalesce(_col(rel), F.array()))


def _hits(rec: Column, rel: Column, k: int) -> Column:
    return F.size(F.filter(_top(rec, k), lambda x: F.array_contains(rel, x)))


def ideal_dcg(m: Column) -> Column:
    """Sum of 1/log2(i+1) for i = 1..m (0 when m <= 0)."""
    return F.when(m <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1))
    )


def precision_at_k(rec: str | Column, rel: str | Column, k: int) -> Column:
    """Hits in the first k / k; 0 when k <= 0 or nothing is relevant."""
    if k <= 0:
        return F.lit(0.0)
    relevant = _relevant(rel)
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(_hits(_col(rec), relevant, k) / F.lit(float(k)))


def recall_at_k(rec: str | Column, rel: str | Column, k: int) -> Column:
    """Hits in the first k / number of distinct relevant items."""
    relevant = _relevant(rel)
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(
        _hits(_col(rec), relevant, max(k, 0)) / F.size(relevant).cast("double")
    )


def _hit_flags(rec: Column, rel: Column, k: int) -> Column:
    return F.transform(_top(rec, k), lambda x: F.array_contains(rel, x).cast("int"))


def average_precision_at_k(rec: str | Column, rel: str | Column, k: int) -> Column:
    """Sum over hits of (hits so far / rank), divided by min(|relevant|, k)."""
    if k <= 0:
        raise ValueError("average precision needs k > 0")
    relevant = _relevant(rel)
    flags = _hit_flags(_col(rec), relevant, k)
    # running hit count at each position i (1-based) = sum of flags[0..i-1]
    terms = F.transform(
        flags,
        lambda f, i: f * F.aggregate(F.slice(flags, 1, i + 1), F.lit(0), lambda a, x: a + x) / (i + 1).cast("double"),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(total / F.least(F.size(relevant), F.lit(k)))


def ndcg_at_k(rec: str | Column, rel: str | Column, k: int) -> Column:
    """Binary-gain DCG over the first k, normalised by the ideal DCG."""
    relevant = _relevant(rel)
    flags = _hit_flags(_col(rec), relevant, max(k, 0))
    dcg = F.aggregate(
        F.transform(flags, lambda f, i: f / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x
    )
    idcg = ideal_dcg(F.least(F.size(relevant), F.lit(max(k, 0))))
    return F.when((F.size(relevant) == 0) | (idcg == 0), F.lit(0.0)).otherwise(dcg / idcg)
