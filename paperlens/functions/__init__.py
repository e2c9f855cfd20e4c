"""Column expressions: text, dates, vectors, statistics, percentiles."""
