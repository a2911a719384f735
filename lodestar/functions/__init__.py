"""Column functions: text, vectors, geometry, time, distance, values."""
