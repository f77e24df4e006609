"""The registered queries and the SQL each must agree with."""

from frostgrid.plans.oracle import ORACLE_SQL
from frostgrid.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
