"""voltide: a Spark-native engine for option-market data."""

__version__ = "0.1.0"
