"""Spark-native analytics for location x fortnight vegetation panels."""
