"""Operators over records: tokens, headers, sanitizing, shape."""
