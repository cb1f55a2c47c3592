"""PySpark-native corpus token reduction (sources)."""
