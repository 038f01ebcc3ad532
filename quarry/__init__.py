"""Quarry: a Spark-native engine for text, knowledge-graph and vector retrieval analytics."""
