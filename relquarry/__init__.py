"""A search and retrieval analytics engine on Spark DataFrames."""
