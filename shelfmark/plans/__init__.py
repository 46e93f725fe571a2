"""Shelfmark plans."""
