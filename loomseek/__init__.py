"""A PySpark-native engine for searching and navigating text and source code."""
