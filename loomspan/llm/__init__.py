"""Operators that prepare training text, with the queries that apply them."""
