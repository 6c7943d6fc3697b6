"""All registered queries; importing the modules registers them."""

from veridect.plans import dataset_queries, decision_queries, evaluation_queries, text_queries  # noqa: F401
from veridect.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
