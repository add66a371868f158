"""Whole queries over the corpus tables, with their SQL."""
