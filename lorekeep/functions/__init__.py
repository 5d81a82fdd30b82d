"""Column functions: text, ids, vectors, commands."""
