"""Column functions: text, lines, patterns and spans."""
