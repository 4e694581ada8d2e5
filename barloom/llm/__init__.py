"""Training-data operators: ten independent corpus tools built on Spark DataFrames."""
