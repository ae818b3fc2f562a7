"""Operators over training corpora."""
