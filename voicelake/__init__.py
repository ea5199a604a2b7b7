"""Speech and call analytics on Spark DataFrames."""
