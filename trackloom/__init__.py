"""Trajectory analytics on Spark DataFrames, batch and streaming."""
