"""palaver: search and analytics over recorded conversations, on Spark DataFrames."""
