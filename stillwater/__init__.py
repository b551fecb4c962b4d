"""Spark-native analytics for libraries of measured and labelled frames."""
