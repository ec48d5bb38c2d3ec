"""Spark-native engine for reduction-tree evaluation pipelines."""
