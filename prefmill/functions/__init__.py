"""Column functions: hashing, text, token arrays and numerics."""
