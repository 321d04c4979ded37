"""Column expressions: content ids, times, ratios."""
