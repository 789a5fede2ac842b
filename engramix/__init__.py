"""Engramix: a PySpark-native engine for long-term conversational memory analytics."""
