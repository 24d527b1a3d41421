"""Operators for building training data out of text corpora, and their queries."""
