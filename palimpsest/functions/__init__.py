"""Column expressions: encodings, names, described types and texts."""
