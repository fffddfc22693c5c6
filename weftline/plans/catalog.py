"""All registered queries."""

from weftline.plans import files, gold, pipeline, ranking, small, taxi, text, wrangling  # noqa: F401  each registers its queries
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
