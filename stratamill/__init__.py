"""Stratamill: depth-series and text-evidence analytics on Spark DataFrames."""
