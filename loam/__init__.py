"""Spark-native analytics for block-based (voxel) worlds."""
