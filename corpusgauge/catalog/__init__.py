"""Registered queries: each operator on the given tables, with the same answer
in SQL where SQL can express it."""

from . import (  # noqa: F401
    controls,
    distributions,
    evaluation,
    ingestion,
    lexical,
    modelling,
    quality,
    rows,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
