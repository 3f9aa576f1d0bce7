"""Spark-native engine for evidence-based grouping of large record collections."""
