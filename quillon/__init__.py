"""quillon: semantic search, chunking and indexing on Spark DataFrames."""
