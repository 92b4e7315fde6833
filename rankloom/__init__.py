"""rankloom: ranked-retrieval analytics on Spark DataFrames."""
