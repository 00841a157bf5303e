"""All registered queries, by theme."""

from coverlay.queries import quality, scoring, spatial  # noqa: F401
from coverlay.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
