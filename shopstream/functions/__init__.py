"""Column expressions: text, measures and scores. All are built-in functions, so they stay in generated code."""
