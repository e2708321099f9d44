"""Registered queries, grouped by area. Importing this package fills the registry."""

from riskloom.plans import corpus, documents, evaluation, findings, projects, scoring, streams  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
