"""Fixed patterns and Column-level helpers."""
