"""Queries over the given tables, one or more per operator."""

from cohortline.catalog import agreement, learning, modelling, preparation, reshaping, time_and_folds  # noqa: F401
from cohortline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
