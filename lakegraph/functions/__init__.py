"""Column functions: text clean-up and typed values."""
