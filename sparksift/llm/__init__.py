"""Operators for building training data from large text corpora, each on its own method."""
