"""All registered queries and their check SQL."""

from cohortlake.catalogue import (  # noqa: F401
    aggregates,
    evaluation,
    labelling,
    modelling,
    projections,
    splitting,
    storage,
    timeseries,
)
from cohortlake.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
