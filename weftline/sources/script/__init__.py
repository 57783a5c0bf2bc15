"""Script sources: text to syntax tree to scope tables, one file at a time."""
