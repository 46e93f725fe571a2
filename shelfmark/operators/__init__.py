"""Relational, vector, graph and ranking operators."""
