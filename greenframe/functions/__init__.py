"""Column expressions, prompt texts and fixed values."""
