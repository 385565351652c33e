"""Column expressions: every function takes and returns Columns, no action runs."""
