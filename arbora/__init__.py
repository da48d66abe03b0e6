"""Queries over sequences, trees, JSON, text and tables, planned as Spark DataFrames."""
