"""A PySpark-native corpus indexing and retrieval engine."""
