"""Column functions: keys, text, JSON, arrays, mathematics."""
