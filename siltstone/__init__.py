"""Spark-native knowledge analytics: chunking, retrieval, relational queries, lifecycle and streaming."""
