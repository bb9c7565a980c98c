"""Importing the query modules fills the registry."""

from trajlake.plans import q_core, q_data, q_runs, q_spatial  # noqa: F401
from trajlake.plans.registry import ORACLE, QUERIES  # noqa: F401
