"""Operators for building training corpora on Spark; see each module's docstring."""
