"""Tessera: a PySpark-native engine for duplicate review, import planning and corpus preparation."""
