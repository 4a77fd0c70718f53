"""Search-relevance analytics and training-data operators on Spark DataFrames."""
