"""Tessera: a Spark-native engine for review analytics."""
