"""The named analyses, the query registry and the SQL oracles."""

from vitalspark.plans.analyses import ANALYSES, Params
from vitalspark.plans.registry import EVENT_PARAMS, oracle_sql, queries, run_analysis

__all__ = ["ANALYSES", "EVENT_PARAMS", "Params", "oracle_sql", "queries", "run_analysis"]
