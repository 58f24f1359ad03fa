"""A Spark-native engine that turns web pages and documents into training data."""

__version__ = "0.1.0"
