"""Column functions: text, numbers, dates, keyed hashing and PHI patterns."""
