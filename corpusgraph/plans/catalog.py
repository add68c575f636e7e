"""All registered queries; importing the modules fills the registry."""

from corpusgraph.plans import queries_graph, queries_lookup, queries_source  # noqa: F401
from corpusgraph.plans.registry import QUERIES, oracle_statements

ORACLE_STATEMENTS = oracle_statements()

__all__ = ["ORACLE_STATEMENTS", "QUERIES"]
