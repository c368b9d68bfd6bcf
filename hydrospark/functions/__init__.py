"""Column builders: every scalar rule as a built-in expression, never a Python row function."""
