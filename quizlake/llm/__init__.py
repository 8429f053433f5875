"""Operators over the texts of training data. Nothing outside this package imports it."""
