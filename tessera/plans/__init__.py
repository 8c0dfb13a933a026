"""Every query of the library, by name, and its SQL where SQL can express it."""

from .registry import QUERIES, SQL, Tables
from . import q_intervals, q_aggregates, q_models, q_more, q_relational, q_scalars, q_statistics, q_streaming, q_summaries  # noqa: F401

__all__ = ["QUERIES", "SQL", "Tables"]
