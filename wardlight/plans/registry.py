"""Every registered query with its DuckDB twin."""

from wardlight.plans import gate_queries, geometry_queries, roster_queries, scalar_queries, source_queries, spatial_queries  # noqa: F401
from wardlight.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
