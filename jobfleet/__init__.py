"""Job-fleet notification analytics on Spark DataFrames."""
