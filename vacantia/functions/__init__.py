"""Column functions: text, keys, times, patterns."""
