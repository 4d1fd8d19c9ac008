"""Imports the query modules, so that the registry is complete."""

from passages.llm import media_queries, overlap_queries, scoring_queries, structure_queries  # noqa: F401
from passages.llm.registry import ORACLES, QUERIES  # noqa: F401
