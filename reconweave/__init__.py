"""Settlement reconciliation for many merchants at once, on Spark DataFrames."""
