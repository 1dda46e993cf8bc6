"""Docketry: a PySpark-native engine for legislative analytics."""
