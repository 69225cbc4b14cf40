"""Hot-key handling for joins whose sides AQE cannot split.

AQE splits a skewed sort-merge join only when both sides come straight out
of a shuffle.  Here one side is often the output of an aggregate or a window
that is already partitioned on the join key (neighbour lists per item, key
sets per user), so a key holding a third of all rows would still be joined
in one task.  ``salted_join`` spreads such keys explicitly and exactly:

* ``hot_keys`` finds the keys whose row count exceeds a share of all rows
  (default 1 / (2 * shuffle partitions)) and an absolute floor
  (``spark.clickrank.skew.minHotRows``, default one million rows: below that
  a key is never a straggler worth splitting); there are at most 1/share of
  them, so the list that comes back to the driver is bounded.
* big-side rows of a hot key get a deterministic salt in [0, salts)
  (a hash of their own columns, so a retried task salts identically); the
  small-side rows of a hot key are repeated once per salt; all other rows
  use salt 0.  Inner, left-semi and left-anti results are unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
SALTING_CONF = "spark.clickrank.skew.salting"
MIN_HOT_ROWS_CONF = "spark.clickrank.skew.minHotRows"
DEFAULT_MIN_HOT_ROWS = 1_000_000


def salting_enabled(df: DataFrame) -> bool:
    return df.sparkSession.conf.get(SALTING_CONF, "true").lower() == "true"


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_keys(counts: DataFrame, key: str, count_col: str = "n", share: float | None = None,
             min_rows: int | None = None, rows_bound: int | None = None) -> list:
    """Keys of a (key, count) table holding more than ``share`` of all counted rows (and ``min_rows``).

    ``rows_bound`` is a known upper bound on the counted rows (e.g. the event
    count a table was derived from); when it is below ``min_rows`` no key can
    be hot and no job runs.
    """
    share = share if share is not None else 1.0 / (2 * _partitions(counts))
    if min_rows is None:
        min_rows = int(counts.sparkSession.conf.get(MIN_HOT_ROWS_CONF, str(DEFAULT_MIN_HOT_ROWS)))
    if rows_bound is not None and rows_bound <= min_rows:
        return []
    # one pass tells whether any key is hot at all, which is rare; only then a second finds them
    most, total = counts.agg(F.max(count_col), F.sum(count_col)).first()  # NULL if empty
    if most is None or most <= max(min_rows, total * share):
        return []
    hot = (
        counts.where((F.col(count_col) > F.lit(total * share)) & (F.col(count_col) > F.lit(min_rows)))
        .select(key)
        .limit(int(1 / share) + 1)  # cannot bind: at most 1/share keys exceed the share
        .collect()
    )
    return [row[0] for row in hot]


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                hot: Sequence | None = None, salts: int | None = None,
                salt_columns: Sequence[str] | None = None, rows_bound: int | None = None) -> DataFrame:
    """``big.join(small, key, how)`` with the hot keys of ``big`` spread over ``salts`` tasks.

    ``hot`` defaults to the hot keys of ``big`` (one extra aggregate job, or
    none when ``rows_bound`` rules hot keys out); pass them when the counts
    are already known.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"salted join supports inner, left_semi and left_anti, not {how!r}")
    if not salting_enabled(big):
        return big.join(small, key, how)
    if hot is None:
        hot = hot_keys(key_counts(big, key), key, rows_bound=rows_bound)
    if not hot:
        return big.join(small, key, how)
    salts = salts or _partitions(big)
    is_hot = F.col(key).isin(list(hot))
    source = F.xxhash64(*[F.col(c) for c in (salt_columns or big.columns)])
    big_salted = big.withColumn(SALT, F.when(is_hot, F.pmod(source, F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    small_salted = small.select("*", F.explode(copies).alias(SALT))
    return big_salted.join(small_salted, [key, SALT], how).drop(SALT)
