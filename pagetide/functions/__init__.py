"""Column expressions: URLs, text, markup, dates and labels."""
