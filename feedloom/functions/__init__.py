"""Column helpers: text, numbers, dates and multi-pattern search."""
