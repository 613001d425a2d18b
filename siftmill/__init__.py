"""Corpus-scale source-text analytics on Spark."""
