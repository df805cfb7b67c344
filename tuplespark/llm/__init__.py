"""Training-data operators: ten operators, their queries and their SQL.

Nothing else in the library imports this package."""
