"""Spark-native text-knowledge ETL, refinement and retrieval."""
