"""Column functions: vectors, geometry, text."""
