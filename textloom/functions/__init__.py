"""Column functions: text, paths, references."""
