"""Relational building blocks Spark has no single operator for."""
