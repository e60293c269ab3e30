"""Spark-native analytics for industrial meter telemetry."""

__version__ = "0.1.0"
