"""paperlake: a PySpark-native analytics engine for document libraries."""

__version__ = "0.1.0"
