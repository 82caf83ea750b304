"""Structured Streaming over delimited text."""
