"""A PySpark-native engine for measuring and reducing the token cost of text corpora."""
