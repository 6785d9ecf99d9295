"""All registered queries."""

from quillon.plans import function_queries, other_queries, relational_queries, statement_queries  # noqa: F401
from quillon.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
