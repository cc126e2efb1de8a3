"""Spark-native raster, vector and coastal analytics on DataFrames."""
