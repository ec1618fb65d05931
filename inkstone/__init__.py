"""Inkstone: a PySpark-native analytics engine for text corpora, knowledge bases and call ledgers."""
