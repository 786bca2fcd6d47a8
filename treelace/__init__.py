"""treelace: documents as trees, queried through Spark's DataFrame and SQL engine."""

__version__ = "0.1.0"
