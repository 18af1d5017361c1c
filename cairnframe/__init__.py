"""Spark-native analytics over object-store catalogues."""
