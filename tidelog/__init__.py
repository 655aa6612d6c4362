"""Versioned key-value analytics over Spark DataFrames."""
