"""Spark-native analytics for animal tracks, dives and growth-dated tissue records."""
