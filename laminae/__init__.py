"""Spark-native volumetric analytics: voxels, surfaces and graphs as DataFrames."""
