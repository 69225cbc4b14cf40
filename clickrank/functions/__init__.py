"""Column expressions: weights, time, hashing, scores and per-list metrics."""

from clickrank.functions.columns import (
    SAMPLE_BUCKETS,
    epoch_ms_to_timestamp,
    event_weight,
    event_weight_or_zero,
    exact_score,
    implicit_score,
    sample_threshold,
    user_bucket,
    weight_map,
)
from clickrank.functions.ranking import (
    average_precision_at_k,
    ideal_dcg,
    ndcg_at_k,
    precision_at_k,
    recall_at_k,
)

__all__ = [
    "SAMPLE_BUCKETS",
    "average_precision_at_k",
    "epoch_ms_to_timestamp",
    "event_weight",
    "event_weight_or_zero",
    "exact_score",
    "ideal_dcg",
    "implicit_score",
    "ndcg_at_k",
    "precision_at_k",
    "recall_at_k",
    "sample_threshold",
    "user_bucket",
    "weight_map",
]
