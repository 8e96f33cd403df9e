"""Statements over tables with a schema, as native DataFrame operations."""
