"""Column expressions: text, wages, dates, case numbers, argument checks."""
