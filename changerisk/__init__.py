"""changerisk: change-risk analytics over version-control facts, on PySpark."""

__version__ = "0.1.0"
