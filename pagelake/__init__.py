"""PySpark-native analytics over page-structured documents."""

__version__ = "0.1.0"
