"""Column expressions for text, glossaries and boxes."""
