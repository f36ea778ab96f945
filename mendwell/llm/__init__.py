"""Operators for building training data from a corpus, each over plain DataFrames."""
