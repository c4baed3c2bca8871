"""Column functions: text rules, JSON coercion, fixed word lists."""
