"""Shelfmark functions."""
