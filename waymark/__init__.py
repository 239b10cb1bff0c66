"""Spatial-map, trajectory and descriptor analytics on Spark DataFrames."""
