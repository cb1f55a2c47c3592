"""PySpark-native corpus token reduction (plans)."""
