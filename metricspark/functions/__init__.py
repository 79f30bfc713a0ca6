"""Column builders: text, dates, criteria, label evidence, value comparison."""
