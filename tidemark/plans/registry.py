"""Registered queries and their SQL equivalents, gathered from the plan modules."""

from tidemark.plans import audits, catalogue, dictionaries, domain, nested, pipes, profiles, relational, reviews, traffic  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
