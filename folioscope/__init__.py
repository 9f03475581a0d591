"""A Spark analytics engine for scholarly-metadata catalogs."""
