"""Scalar functions on titles, terms and marked-up text."""
