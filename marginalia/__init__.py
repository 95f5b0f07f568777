"""Marginalia: a PySpark-native text-search and catalogue analytics engine."""
