"""Column expressions: distributions, text, seeded draws, statistics."""
