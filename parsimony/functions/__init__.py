"""PySpark-native corpus token reduction (functions)."""
