"""Plans composed of operators: the registered queries, publication and ingestion."""


def load_queries():
    """All registered queries, and the SQL of those that have some."""
    from folioscope.plans import analytics_queries, catalog_queries, function_queries, ingestion_queries, integrity_queries, state_queries  # noqa: F401
    from folioscope.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
