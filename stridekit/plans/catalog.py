"""All registered queries: importing this module registers every query module."""

from . import (  # noqa: F401  (imported for their registrations)
    anomaly_queries,
    corpus_queries,
    dialogue_queries,
    extract_queries,
    sentiment_queries,
    source_queries,
    streaming_queries,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
