"""Spark-native analytics for frame sequences: rasters, label maps, depth fields, strokes and their quality metrics."""
