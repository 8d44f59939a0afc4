"""Column functions: text, regular expressions with offsets, geometry, and the fixed vocabulary."""
