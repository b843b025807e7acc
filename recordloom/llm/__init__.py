"""Operators for preparing training data. Nothing outside this package uses it."""
