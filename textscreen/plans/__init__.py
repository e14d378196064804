"""Registered queries: one per operator, on the given tables, with the SQL that checks it."""

from . import curriculum, evaluation, modelling, sequencing, shaping, sources  # noqa: F401
from .registered import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
