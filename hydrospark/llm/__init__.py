"""Operators for preparing language-model training text; queries are in `queries`."""
