"""Compression of conversation histories on Spark: turns in a DataFrame, stages from DataFrame to DataFrame."""
