"""Integer-range analytics on Spark DataFrames."""
