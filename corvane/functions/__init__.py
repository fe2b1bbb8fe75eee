"""Column expressions: text, JSON and vectors."""
