"""Tidemark: a PySpark-native engine for market data, features and backtests."""

__version__ = "0.1.0"
