"""Hybrid retrieval, graph analytics and corpus operators on Spark DataFrames."""
