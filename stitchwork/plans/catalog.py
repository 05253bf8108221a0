"""Every registered query: importing the sections fills the registry."""

from stitchwork.plans import (  # noqa: F401
    queries_aggregates, queries_filters, queries_jobs, queries_joins, queries_scalars, queries_sets, queries_sources,
    queries_windows)
from stitchwork.plans.registry import ORACLES, QUERIES  # noqa: F401
