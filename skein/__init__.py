"""Spark-native scholarly-corpus analytics."""
