"""Spark-native analytics for radar raster tables."""
