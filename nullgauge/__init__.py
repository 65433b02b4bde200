"""Null-calibrated screening and evidence analytics on Spark DataFrames."""
