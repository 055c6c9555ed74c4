"""Property-sale register analytics on Spark DataFrames."""
