"""All queries of the library and their SQL, by name."""

from wayfield.plans import queries as plans
from wayfield.plans import edit_queries, list_queries, node_queries, place_queries, surface_queries, zone_queries  # noqa: F401  register their queries


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict:
    return dict(plans.SQL)
