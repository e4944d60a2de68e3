"""Every query by name, with its equivalent in SQL."""

from evigrain.plans import analytics, details, evidence, graph, indexes, knowledge, papers, protocols, records, retrieval, runs, sequences, text  # noqa: F401
from evigrain.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
