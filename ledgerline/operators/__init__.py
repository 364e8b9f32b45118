"""Relational operators built from Spark DataFrame primitives."""
