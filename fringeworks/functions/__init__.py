"""Column expressions and scalars that the operators share."""
