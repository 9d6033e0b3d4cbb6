"""Spatial scale analysis of fields on meshes, as Spark DataFrames."""
