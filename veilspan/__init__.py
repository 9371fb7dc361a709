"""De-identification and span analytics on Spark DataFrames."""
