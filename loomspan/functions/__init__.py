"""Column functions and p-values."""
