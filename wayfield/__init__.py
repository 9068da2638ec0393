"""Spark-native analytics of movement trails, regions and placements."""
