"""Table reconciliation on Spark: which keys of a copy are missing, extra or changed."""

__version__ = "0.1.0"
