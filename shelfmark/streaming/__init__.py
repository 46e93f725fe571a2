"""Shelfmark streaming."""
