"""Column functions: text, patterns and vectors."""
