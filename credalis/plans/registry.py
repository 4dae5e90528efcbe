"""Imports every query module so that the catalog is complete."""

from credalis.plans import (  # noqa: F401
    overview,
    q_dist,
    q_join,
    q_rank,
    q_recal,
    q_resample,
    q_sample,
    q_score,
    q_sources,
    q_stream,
    q_text,
    studies,
)
from credalis.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
