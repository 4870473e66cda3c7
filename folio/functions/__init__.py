"""Column functions: text, geometry, identifiers."""
