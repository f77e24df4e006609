"""Time-series and event analytics on Spark DataFrames."""
