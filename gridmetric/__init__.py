"""Raster-evaluation analytics on Spark DataFrames."""
