"""Time-series analytics over many series at once, on Spark DataFrames."""
