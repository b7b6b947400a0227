"""Operators for the preparation of text corpora."""
