"""Bar operators: functions from DataFrames to DataFrames."""
