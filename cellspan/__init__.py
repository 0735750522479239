"""cellspan: Spark-native analytics for cycle-structured sensor series."""

__version__ = "0.2.0"
