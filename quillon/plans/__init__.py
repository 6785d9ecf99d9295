"""Queries: a fluent builder, and the registered ones with their SQL."""
