"""Operators for preparing training text and vectors, one module each."""
