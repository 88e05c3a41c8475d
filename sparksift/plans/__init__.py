"""Whole audits, assembled from the operators."""
