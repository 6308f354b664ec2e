"""Column expressions: money rounding, labels, text cleansing."""
