"""Hybrid retrieval and question-answering data engine on Spark DataFrames."""
