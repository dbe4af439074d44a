"""Volumetric scene jobs on Spark DataFrames."""
