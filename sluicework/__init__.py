"""Sluicework: a PySpark-native engine for web-page extraction, record resolution and ranking."""
