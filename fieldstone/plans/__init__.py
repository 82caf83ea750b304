"""Declarations: dialects, schemas, read specifications."""
