"""The registered queries: each reads the given tables, with the SQL that checks it where SQL can say it."""

from provenant.plans.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
