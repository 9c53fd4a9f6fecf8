"""All queries of the library with their SQL."""

from . import queries_control, queries_grid, queries_models, queries_neural, queries_signal  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
