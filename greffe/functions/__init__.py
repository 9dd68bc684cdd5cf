"""Column functions: texts, rules, replies."""
