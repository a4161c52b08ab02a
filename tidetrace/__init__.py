"""Knowledge-guided time-series analytics on Spark DataFrames."""
