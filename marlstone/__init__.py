"""marlstone: a small analytics engine whose only execution layer is Spark SQL."""

__version__ = "0.1.0"
