"""Column functions that compose built-in expressions."""
