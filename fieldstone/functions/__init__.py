"""Typed parsing of text columns."""
