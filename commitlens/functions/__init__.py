"""Column expressions: predicates on paths and names, name formatting, history text."""
