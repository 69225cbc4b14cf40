"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The user sampler hashes into this many buckets.
SAMPLE_BUCKETS = 10000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weight_map(weights: Mapping[str, float]) -> Column:
    """Literal map event -> weight (constant-folded by Catalyst)."""
    if not weights:
        return F.create_map().cast("map<string,double>")
    parts: list[Column] = []
    for event, weight in weights.items():
        parts += [F.lit(event), F.lit(float(weight))]
    return F.create_map(*parts)


def event_weight(event: str | Column, weights: Mapping[str, float]) -> Column:
    """Weight of an event; NULL when the event has no configured weight."""
    return weight_map(weights)[_col(event)].cast("double")


def event_weight_or_zero(event: str | Column, weights: Mapping[str, float]) -> Column:
    """Weight of an event, 0.0 when it has none."""
    return F.coalesce(event_weight(event, weights), F.lit(0.0))


def epoch_ms_to_timestamp(ms: str | Column) -> Column:
    """Epoch milliseconds -> timestamp at whole seconds (milliseconds truncated)."""
    return F.timestamp_seconds((_col(ms) / F.lit(1000)).cast("long"))


def implicit_score(raw: str | Column, use_log_score: bool = True) -> Column:
    """log1p of the summed weights, or the sum itself."""
    raw_col = _col(raw)
    return (F.log1p(raw_col) if use_log_score else raw_col).cast("double")


def user_bucket(user: str | Column) -> Column:
    """Stable bucket in [0, 10000) from Murmur3 of the (int) user id.

    The hash is widened to bigint before ``abs`` so INT_MIN cannot overflow.
    """
    return F.pmod(F.abs(F.hash(_col(user)).cast("long")), F.lit(SAMPLE_BUCKETS))


def sample_threshold(fraction: float) -> int:
    return int(fraction * SAMPLE_BUCKETS)


def exact_score(score: str | Column) -> Column:
    """Score as decimal(28,12) so sums do not depend on summation order."""
    return _col(score).cast("decimal(28,12)")
