"""Imports every query module, so that the registry is complete."""

from passages.plans import (  # noqa: F401
    chunk_queries,
    decode_queries,
    evaluation_queries,
    learning_queries,
    retrieval_queries,
    sequence_queries,
    table_queries,
    text_queries,
    vector_queries,
)
from passages.plans.registry import ORACLES, QUERIES  # noqa: F401
