"""Millrace: a PySpark-native engine for loosely typed tables, documents and records."""

__all__ = ["errors", "functions", "operators", "plans", "session", "sources", "streaming"]
