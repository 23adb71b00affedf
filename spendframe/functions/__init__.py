"""Column expressions: numbers, dates and repeatable random draws."""
