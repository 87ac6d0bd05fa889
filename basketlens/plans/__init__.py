"""Query plans: every registered query with its oracle SQL."""

from . import (commerce_queries, experiment_queries, feature_queries, metric_queries,  # noqa: F401
               ml_queries, recommend_queries, stream_queries,
               similarity_queries, store_queries)
from .registry import DOCS, ORACLES, QUERIES  # noqa: F401
