"""Corpus search, graph and training-data operators as Spark plans."""
