"""Market analytics on Spark DataFrames; see README.md."""
