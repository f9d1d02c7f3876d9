"""Column functions: text, scripts, regular expressions."""
