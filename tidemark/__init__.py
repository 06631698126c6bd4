"""A PySpark-native analytics engine for event, tick, bar and reference data."""
