"""All registered queries, by section of the inventory."""
from . import q_aggregates, q_areas, q_joins, q_models, q_reports, q_scans, q_scalars  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
