"""Delimited text and NDJSON as typed Spark DataFrames."""
