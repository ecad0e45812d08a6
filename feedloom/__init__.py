"""feedloom: a PySpark-native analytics engine for customer feedback."""

__version__ = "0.1.0"
