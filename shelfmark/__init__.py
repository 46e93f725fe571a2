"""Shelfmark: a Spark-first engine for catalogue analytics, reader profiles and ranking."""
