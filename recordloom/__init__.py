"""Spark-native engine that turns semi-structured records into audited tables."""
