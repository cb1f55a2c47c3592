"""PySpark-native corpus token reduction (streaming)."""
