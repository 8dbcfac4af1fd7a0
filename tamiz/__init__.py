"""Approximate matching over catalogue tables, as DataFrame operations."""
