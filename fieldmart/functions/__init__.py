"""Column expressions: classifiers, score arithmetic, calendar and money helpers."""
