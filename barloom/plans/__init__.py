"""Operators put together, with the queries and their SQL."""
