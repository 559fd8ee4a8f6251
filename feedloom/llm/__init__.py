"""Operators for preparing training data, built on Spark jobs over shared files."""
