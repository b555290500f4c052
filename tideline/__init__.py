"""Learning analytics, observability, retrieval and corpus preparation on Spark DataFrames."""
