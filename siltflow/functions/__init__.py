"""Column expressions: texts, URIs, names. Built-in functions where Spark has them, Arrow functions elsewhere."""
