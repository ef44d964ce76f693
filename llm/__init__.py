"""Operators for preparing training text, one module for each method, and the queries that apply them."""
