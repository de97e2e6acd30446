"""Spark-native retrieval, impact-analysis and corpus engine."""
