"""A PySpark-native engine for comparative sequence data."""
