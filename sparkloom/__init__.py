"""Spark-native knowledge-graph retrieval engine."""
