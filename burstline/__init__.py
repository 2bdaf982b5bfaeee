"""Burst-event analytics on Spark DataFrames."""
