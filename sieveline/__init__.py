"""Spark-native cleansing, data-quality and corpus operators."""
