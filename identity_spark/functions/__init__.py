"""Column expressions: boxes, vectors, names."""
