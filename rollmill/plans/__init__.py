"""Registered queries and their oracles."""

from rollmill.plans import batches, credit, evaluation, grading, preparation, runs, scans, streams  # noqa: F401
from rollmill.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
