"""Spark-native analytics for daily probability panels."""
