"""foliant: document analytics on Spark DataFrames."""
