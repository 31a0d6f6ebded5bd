"""Column expressions: numbers, text, names, places, rules."""
