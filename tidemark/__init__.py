"""Spark-native analytics over versioned ledger tables."""
