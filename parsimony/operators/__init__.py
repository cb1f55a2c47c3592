"""PySpark-native corpus token reduction (operators)."""
