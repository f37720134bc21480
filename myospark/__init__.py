"""Spark-native analytics for multichannel biosignal recordings."""
