"""Column expressions: text, rules, signals, sketches."""
