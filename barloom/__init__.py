"""Daily-bar market analytics on Spark DataFrames."""
