"""retrievo: ranked retrieval, relevance evaluation and corpus preparation on Spark DataFrames."""
