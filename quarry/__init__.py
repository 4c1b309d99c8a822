"""Full-text search and indexing on Spark DataFrames."""
