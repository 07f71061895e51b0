"""Spark-native analytics for chromosome contact data and large record sets."""
