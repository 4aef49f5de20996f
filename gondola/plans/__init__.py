"""Queries that answer several questions in one pass."""
