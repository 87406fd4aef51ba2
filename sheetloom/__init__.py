"""Spark-native analytics of grid-shaped documents."""
