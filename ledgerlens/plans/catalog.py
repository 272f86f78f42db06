"""All registered queries; importing the modules fills the registry."""

from . import clean_queries, model_queries, profile_queries, score_queries, source_queries, stream_queries, training_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
