"""Shelfmark sources."""
