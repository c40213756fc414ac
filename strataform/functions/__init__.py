"""Column functions: exact decimals, text and period parsing, geometry."""
