"""Spark-native operators for documents, text and file records."""
