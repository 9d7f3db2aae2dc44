"""Spark-native analytics for anomaly scores of a fleet of devices."""
