"""Relational, graph and annotation operators."""
