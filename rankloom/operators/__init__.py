"""Relevance features, similarity, text scores, link graph and learning to rank on DataFrames."""
