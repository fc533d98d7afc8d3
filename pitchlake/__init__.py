"""Spark-native analytics over tracking data."""
