"""Column-level building blocks (pure Catalyst expressions)."""
