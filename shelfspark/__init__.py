"""shelfspark: shelf-audit analytics on Spark DataFrames."""
