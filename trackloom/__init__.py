"""Spark-native analytics over tracking tables."""
